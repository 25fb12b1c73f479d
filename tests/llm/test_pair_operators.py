import random

import numpy as np
import pandas as pd
import pytest

from lodestream.llm import history, leakage, neardup, simjoin


def brute(texts):
    sets = {}
    for k, t in texts.items():
        s = "".join(c for c in t.lower() if c.isalnum())
        sets[k] = {s[i : i + 9] for i in range(len(s) - 8)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}


def corpus(seed=1, n=60):
    """Texts of a small vocabulary, with edited, cut, extended and reordered copies."""
    rnd = random.Random(seed)
    words = ["w" + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(120)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(35, 90))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randrange(len(w))
            w[i : i + 1] = rnd.choice([[], [rnd.choice(words)], [w[i], rnd.choice(words)]])
        cut = rnd.randint(0, 12)
        out.append(" ".join(rnd.choice([w, w[cut:] + w[:cut], w[cut:]])))
    return [t if len(t.replace(" ", "")) >= 150 else t + " pad" * 60 for t in out]


def test_pairs_equal_brute_force(spark, envelopes):
    texts = corpus()
    rows = [(f"h{i:03}", "s", i % 5, f"https://x/{i}", "" if i % 3 else None, t, None) for i, t in enumerate(texts)]
    rows += [rows[0], ("short", "s", 0, None, None, "too short", None), ("null", "s", 0, None, None, None, None), ("copy", "s", 1, None, "", texts[4].upper() + "!!", None)]
    want = brute({r[0]: (r[4] or "") + r[5] for r in rows if r[5] and r[0] != "short"})
    got = {(r["harvest_id_a"], r["harvest_id_b"]) for r in neardup.pairs(envelopes(rows)).collect()}
    assert len(want) > 20 and got == want
    groups = {r["harvest_id"]: r["group_id"] for r in neardup.groups(envelopes(rows)).collect()}
    assert len(groups) == len(texts) + 1 and all(groups[a] == groups[b] for a, b in want)
    assert neardup.pairs(envelopes([])).count() == 0


def similar_keys(texts):
    key = [simjoin.key_of(simjoin.squashed(t)) for t in texts]
    want = brute({f"{i:03}": t for i, t in enumerate(texts)})
    return {frozenset((key[int(a)], key[int(b)])) for a, b in want if key[int(a)] != key[int(b)]}


def records_of(spark, texts):
    return spark.createDataFrame([(str(i), "", t) for i, t in enumerate(texts)], "harvest_id string, title string, content string")


@pytest.mark.parametrize("fragments, parts, hot", [(1, 1, 10**6), (3, 4, 10**6), (2, 1, 6), (40, 3, 4)])
def test_fragments_lose_nothing(spark, fragments, parts, hot):
    """Candidates of any number of fragments, parts and slices of hot tokens hold every similar pair."""
    texts = corpus(9, 90)
    records = records_of(spark, texts)
    levels = spark.sparkContext.broadcast(simjoin.rarity(simjoin.scanned(records, bits=12), bits=12))
    plan = simjoin.Plan(fragments, parts, hot)
    blocks = simjoin.segments(records, levels, plan)
    assert parts == 1 or blocks.select("part").distinct().count() > 1
    assert hot > 10 or blocks.filter("slices > 1").count() > 0
    got = simjoin.candidates(blocks, plan).collect()
    assert similar_keys(texts) <= {frozenset(((r["ax"], r["bx"]), (r["ay"], r["by"]))) for r in got}


def history_rows():
    texts = corpus(4, 45)
    url = lambda i: f"https://www.video.example/watch?v={i % 40}&t=0s" if i % 2 else f"http://m.Video.example/watch/?ref=x&t=0s&v={i % 40}#c"
    rows = [(f"h{i:03}", "s", i % 9, url(i), "", t, None) for i, t in enumerate(texts)] + [("s1", "s", 0, None, None, "tiny", None), ("s2", "s", 3, "", None, None, None)]
    rows += [("c1", "s", 5, None, "", texts[2].upper(), None), ("c2", "s", 7, None, "", texts[2].upper(), None), rows[3]]
    batch = {r[0]: r[2] for r in rows}
    want = set()
    for a, b in brute({r[0]: r[5] for r in rows if r[5] and len(r[5]) > 20}):
        if batch[a] != batch[b]:
            want.add(a if batch[a] > batch[b] else b)
    first = {}
    for i in range(len(texts)):
        first[i % 40] = min(first.get(i % 40, 9), i % 9)
    want |= {f"h{i:03}" for i in range(len(texts)) if first[i % 40] < i % 9}
    return rows, want


@pytest.mark.parametrize("probe, run", [(50_000, 1), (0, 4)])
def test_history_batch_by_batch(spark, envelopes, monkeypatch, probe, run):
    """Nine landings or three, with merges and a new order between them; probes broadcast or joined by fragment."""
    monkeypatch.setattr(history, "PROBE_RECORDS", probe)
    monkeypatch.setattr(history, "REORDER", 3)
    monkeypatch.setattr(history, "FAN", 3)
    rows, want = history_rows()
    assert {r["harvest_id"] for r in history.replay(envelopes(rows), run).collect()} == want and len(want) > 15
    assert history.found(envelopes([])).count() == 0


@pytest.mark.parametrize("probe", [50_000, 0])
def test_history_with_hot_windows_and_parts(spark, envelopes, monkeypatch, probe):
    monkeypatch.setattr(history, "PROBE_RECORDS", probe)
    rows, want = history_rows()
    index = history.HistoryIndex(spark, plan=simjoin.Plan(2, 3, 4))
    landed = history.arrivals(envelopes(rows))
    got = [index.land(landed.filter(f"batch_no between {a} and {b}")) for a, b in ((0, 4), (5, 9))]
    assert {r["harvest_id"] for df in got for r in df.collect()} == want
    index.drop()


def test_a_landing_reads_no_more_than_it_needs(spark, envelopes, tmp_path):
    """What a landing has in the index stays as few parts; merged ones are gone from the folder."""
    rows, _ = history_rows()
    index = history.HistoryIndex(spark, str(tmp_path))
    landed = history.arrivals(envelopes(rows))
    for b in range(7):
        index.land(landed.filter(f"batch_no = {b}"))
    assert len(index.items.parts) == len(list((tmp_path / "items").iterdir())) == 2  # six merged into one, and one
    index.drop()
    assert not tmp_path.exists()


def test_addresses(spark):
    urls = ["https://www.a.b/x/?v=1&t=2", "http://m.A.b/x?t=2&utm=3&v=1#f", "a", "", None, "https://a.b/x?v=1", "https://a.b/x/y?v=1&t=2"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(history.address(history.F.col("u")).alias("a"))
    a = [r["a"] for r in df.collect()]
    assert a[0] == a[1] and len({a[0], a[5], a[6]}) == 3 and a[3] is None and a[4] is None


def test_leaks(spark):
    rnd = random.Random(3)
    items = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(25)) for _ in range(12)]
    docs = ["nothing here", None, "", "before " + items[0] + " after", "x " + items[1][20:95].upper() + "!", "y " + items[2][:40], items[3][:60] + " " + items[4][50:120]]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    e = spark.createDataFrame([(i, "t", "en", t) for i, t in enumerate(items)] + [(99, "t", "en", None), (98, "t", "en", "short")], "item_id long, task string, lang string, text string")
    squash = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    want = {(i, j) for i, t in enumerate(docs) for j, u in enumerate(items) if any(squash(u)[k : k + 50] in squash(t) for k in range(len(squash(u)) - 49))}
    assert {(r["doc_id"], r["item_id"]) for r in leakage.found(d.union(d), e).collect()} == want and len(want) == 4
    assert leakage.found(d.limit(0), e).count() == 0


def test_edited_copies(spark):
    """Copies with a word in four replaced, dropped or doubled are all found as edited; other texts of the same words are not."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 9)))
    words = [word() for _ in range(400)]
    items = [[rnd.choice(words) for _ in range(40)] for _ in range(20)]

    def edit(own):
        return " ".join(x for k, w in enumerate(own) for x in ([w] if (k + 2) % 4 else rnd.choice([[], [word()], [w, word()]])))

    docs = [" ".join(word() for _ in range(30)) + " " + edit(i) + " " + word() for i in items] + [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in leakage.leaks(d, e).collect()}
    assert {p for p, kind in got.items() if kind != "slight"} == {(i, i) for i in range(20)}


def test_alignment_equals_the_plain_recurrence():
    import numpy as np

    rnd = random.Random(2)
    for _ in range(20):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(3, 15))) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 2, h[i, j - 1] - 2)
        assert leakage._align(leakage._padded([a]), leakage._padded([b]))[0] == h.max()


def test_partial_overlaps_equal_brute_force(spark):
    """A fragment reports exactly the pairs whose partial overlap reaches its share of the bound."""
    texts = corpus(11, 90)
    records = records_of(spark, texts)
    levels = spark.sparkContext.broadcast(simjoin.rarity(simjoin.scanned(records, bits=12), bits=12))
    plan = simjoin.Plan(3)
    blocks = simjoin.segments(records, levels, plan).toPandas()
    for f, own in blocks.groupby("fragment"):
        side = simjoin.Side(own, plan, 0.7, 0.1)
        sets = {tuple(k): (int(n), set(side.tokens[a:b].tolist())) for k, n, a, b in zip(side.keys.tolist(), side.sizes, side.starts[:-1], side.starts[1:])}
        want = {}
        for a in sets:
            for b in sets:
                (na, sa), (nb, sb) = sets[a], sets[b]
                if a < b and min(na, nb) >= 0.7 * max(na, nb) - 1e-9 and 3 * len(sa & sb) >= max(1, int(simjoin.least_shared(np.array(na), np.array(nb)))):
                    want[frozenset((a, b))] = len(sa & sb)
        found = simjoin.partial_rows(side, side, simjoin.partial_overlaps(side, side, plan, 0.7, 0.1), f)
        assert {frozenset(((r.ax, r.bx), (r.ay, r.by))): r.shared for r in found.itertuples()} == want and len(want) > 20


def test_many_records_send_each_segment_once(spark, envelopes, monkeypatch):
    """Beyond what a group holds, rounds of few records find the same pairs, and no segment is sent twice."""
    monkeypatch.setattr(simjoin, "GROUP_RECORDS", 20)
    monkeypatch.setattr(simjoin, "PROBE_RECORDS", 25, raising=False)
    texts, sent = corpus(21), []
    plain = simjoin.segments
    monkeypatch.setattr(simjoin, "segments", lambda *a, **k: sent.append(plain(*a, **k)) or sent[-1])
    rows = [(f"h{i:03}", "s", 0, None, "", t, None) for i, t in enumerate(texts)] + [("copy", "s", 1, None, "", texts[4].upper() + "!!", None)]
    got = {(r["harvest_id_a"], r["harvest_id_b"]) for r in neardup.pairs(envelopes(rows)).collect()}
    want = {tuple(sorted(p)) for p in brute({r[0]: r[5] for r in rows})}
    assert got == want and len(want) > 20
    assert sent[0].selectExpr("sum(length(sizes)) / 4 n").first()["n"] <= len(set(texts)) * simjoin.FRAGMENTS


def test_a_large_landing_meets_the_history_in_rounds(spark, envelopes, monkeypatch):
    """More records than travel at once: no group holds a fragment, and windows that occur often are not sent apart."""
    monkeypatch.setattr(history, "PROBE_RECORDS", 20)
    monkeypatch.setattr(simjoin, "_UNIT_RECORDS", 10)
    rounds, plain = [], simjoin._rounds
    monkeypatch.setattr(simjoin, "_rounds", lambda *a: rounds.append(plain(*a)) or rounds[-1])
    rows, want = history_rows()
    index = history.HistoryIndex(spark)
    landed = history.arrivals(envelopes(rows))
    got = [index.land(landed.filter(f"batch_no between {a} and {b}")) for a, b in ((0, 4), (5, 9))]
    assert {r["harvest_id"] for df in got for r in df.collect()} == want
    assert all(len(r) > 0 for r in rounds) and len(rounds[0]) > 1 and index.postings.read().filter("part <> 0").isEmpty()
    index.drop()


def drawn_side(rnd, records, plan):
    """Segments of sets of all sizes, drawn from few tokens; half of them near to one of some patterns."""
    patterns = [sorted(rnd.sample(range(300), 120)) for _ in range(3)]
    sizes = [rnd.choice([rnd.randint(1, 12), rnd.randint(100, 420)]) for _ in range(records)]
    held = [max(1, int(simjoin.prefix_size(n)[0]) // plan.fragments + rnd.randint(-2, 3)) for n in sizes]
    tokens = [sorted(rnd.sample(rnd.choice(patterns)[: c + 10], c) if rnd.random() < 0.5 else rnd.sample(range(300), c)) for c in held]
    keys = np.array([[rnd.getrandbits(60), rnd.getrandbits(60)] for _ in sizes], np.int64)
    row = {"keys": keys.tobytes(), "sizes": np.array(sizes, np.int32).tobytes(), "counts": np.array([len(t) for t in tokens], np.uint32).tobytes(), "tokens": np.concatenate(tokens).astype(np.uint32).tobytes()}
    return simjoin.Side(pd.DataFrame([row]), plan, 0.7, 0.1)


@pytest.mark.parametrize("seed, chunk, band", [(1, 80_000, 400_000), (2, 3, 400_000), (3, 80_000, 700), (4, 40, 90)])
def test_overlaps_of_two_sides_equal_brute_force(monkeypatch, seed, chunk, band):
    """Partners of any size, smaller, equal and larger, in any cut of the lists and bands, and of a side with itself."""
    monkeypatch.setattr(simjoin, "_CHUNK", chunk)
    monkeypatch.setattr(simjoin, "_BAND_TOKENS", band)
    rnd, plan = random.Random(seed), simjoin.Plan(3)
    s, t = drawn_side(rnd, 150, plan), drawn_side(rnd, 200, plan)
    for one, two in ((s, t), (t, s), (s, s)):
        sets = [[set(o.tokens[a:b].tolist()) for a, b in zip(o.starts[:-1], o.starts[1:])] for o in (one, two)]
        want = {}
        for x, a in enumerate(sets[0]):
            for y, b in enumerate(sets[1]):
                nx, ny, shared = int(one.sizes[x]), int(two.sizes[y]), len(a & b)
                if (one is not two or x < y) and min(nx, ny) >= 0.7 * max(nx, ny) - 1e-9 and shared >= max(1, -(-int(simjoin.least_shared(np.array(nx), np.array(ny))) // 3)):
                    want[x, y] = shared
        x, y, shared = simjoin.partial_overlaps(one, two, plan, 0.7, 0.1)
        assert dict(zip(zip(x.tolist(), y.tolist()), shared.tolist())) == want and len(want) == len(x) and len(want) > 50


def test_a_text_is_stored_and_keyed_once(spark, envelopes, monkeypatch):
    """A run lands where the items lie, already keyed: nothing but a merge writes items, and no landing keys its texts again."""
    rows, want = history_rows()
    written, keyed, write, key = [], [], history._Log.write, history.keyed
    monkeypatch.setattr(history._Log, "write", lambda log, df: written.append(log.path) or write(log, df))
    monkeypatch.setattr(history, "keyed", lambda df: keyed.append(1) or key(df))
    assert {r["harvest_id"] for r in history.replay(envelopes(rows), 3).collect()} == want
    assert len(keyed) == 1 and len(written) == 3 and not any(path.endswith("/items") for path in written)
