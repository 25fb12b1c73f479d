import random
import re
import uuid

from pyspark.sql import functions as F

from lodestream.functions import ids, text
from lodestream.operators import chunking, filtering, transcripts


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


TEXTS = [None, "", "  ", "a  b", "a\nb", "<b>x</b> &lt;i&gt; &amp; y", "see https://a.b/c?d now", "🔥🔥🔥🔥 hot 🔥", "ﬁne ＡＢ", "t.co/abc end", "[Music] at 12:34 and 1:02:03 [x]", " x\t\n y ", "dưỡng #dưỡng_da 日本。 次"]
NOISE = ["", "", "", "a b", "a\nb", "x <i> & y", "see now", "... hot 🔥", "fine AB", "end", "[Music] at 12:34 and 1:02:03 [x]", "x y", "dưỡng #dưỡng_da 日本。 次"]
SAID = NOISE[:9] + ["t.co/abc end", "at and [x]"] + NOISE[11:]


def test_cleaners(spark):
    assert col(spark, TEXTS, text.clean_noise) == NOISE
    assert col(spark, TEXTS, text.clean_transcript) == SAID


def test_words_and_tokens(spark):
    assert col(spark, TEXTS, text.word_count) == [len((t or "").split()) for t in TEXTS]
    assert col(spark, TEXTS, text.tokens) == [(t or "").lower().split() for t in TEXTS]


def test_sentences(spark):
    want = [[s for s in re.split(r"(?<=[.!?。！？])\s+", (t or "").strip()) if s] for t in TEXTS + ["One. Two?  Three! four"]]
    assert col(spark, TEXTS + ["One. Two?  Three! four"], text.sentences) == want


def test_uuid5(spark):
    names = ["", "a", "héllo", "日本🔥"]
    assert col(spark, names, ids.uuid5_dns) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_chunks_literal():
    assert chunking.pack(None) == chunking.pack("   ") == [] and chunking.pack(" short  text kept ") == ["short  text kept"]
    assert chunking.pack("a b. c d. e f. g h.", 4, 2) == ["a b. c d.", "c d. e f.", "e f. g h."]
    assert chunking.pack("a b. c d. e f. g h.", 4, 0) == ["a b. c d.", "c d. e f.", "e f. g h."]  # one sentence overlaps at least
    assert chunking.pack("a b. c d e f g h. i.", 4, 2) == ["a b.", "a b. c d e f g h.", "c d e f g h. i."]
    assert chunking.pack("a. b. c. d. e. f.", 4, 3) == ["a. b. c. d.", "b. c. d. e.", "c. d. e. f."]


def test_chunks_properties(spark):
    """Nothing is lost, chunks keep the limit but for what overlaps one long sentence, and each goes on from the one before."""
    rnd = random.Random(3)
    texts = [[" ".join("w" * rnd.randint(1, 5) for _ in range(rnd.randint(1, 14))) + f" s{k}." for k in range(rnd.randint(4, 40))] for _ in range(60)]
    for parts in texts:
        whole = " ".join(parts)
        out = [c.split(". ") for c in chunking.pack(whole, 20, 8)]
        numbered = [[int(p.rstrip(".").rsplit("s", 1)[1]) for p in c] for c in out]
        assert sorted({n for c in numbered for n in c}) == list(range(len(parts)))
        for before, own in zip(numbered, numbered[1:]):
            assert own == list(range(own[0], own[-1] + 1)) and before[0] < own[-1] and own[0] <= before[-1] < own[-1]
            kept = [n for n in own if n <= before[-1]]
            assert len(kept) == 1 or sum(len(parts[n].split()) for n in kept) <= 8
        assert all(sum(len(parts[n].split()) for n in c[:-1]) <= 20 for c in numbered)
    df = spark.createDataFrame([(1, " ".join(texts[5]), "x"), (2, None, "y")], "id int, text string, chunk_size string")
    got = chunking.chunk(df, "text", 20, 8).orderBy("chunk_no").collect()
    assert [r["chunk"] for r in got] == chunking.pack(" ".join(texts[5]), 20, 8) and {r["chunk_size"] for r in got} == {"x"}


def test_post_rules(spark):
    ok = " ".join(["word"] * 15)
    rows = [ok, " ".join(["word"] * 14), "@a " + ok, ok + " #a #b #c", ok + " #a #b #c #d", ok + " @a @b", ok + " @a @b @c", ok + " link in bio", ok + " Join our Discord", "gm " + ok, "gmail " + ok, ok + " blink in bio", None, " " + ok + "\n"]
    assert col(spark, rows, filtering.is_clean_post) == [True, False, False, True, False, True, False, False, False, False, True, True, False, True]


def test_layers_and_funnel(spark):
    words = " ".join(["word"] * 40)
    rows = [(1, "x_twscrape", "t", words), (2, "x_twscrape", "t", "short"), (3, "youtube_shorts", "the title of nine words is not that long", "<b></b> " + "[music] " * 3), (4, "youtube_long", None, words), (5, "other", "t", words), (6, "youtube_long", "t", None)]
    df = filtering.layers(spark.createDataFrame(rows, "id int, plugin_type string, title string, content string"))
    got = {r["id"]: r for r in df.collect()}
    assert [got[i]["pass_l2"] for i in range(1, 7)] == [True, False, True, True, False, False]
    assert got[3]["clean_content"].startswith("the title") and got[4]["judge_text"] == words
    judged = df.withColumn("verdict", F.col("id") == 1).withColumn("cached", F.col("id") == 1)
    total = {r["plugin_type"]: tuple(r)[1:] for r in filtering.funnel(judged).collect()}
    assert total["x_twscrape"] == (2, 1, 1, 1, 0) and total["youtube_long"] == (2, 1, 1, 0, 1) and total["other"] == (1, 0, 0, 0, 0)
    settings = spark.createDataFrame([("min_words_post", "1"), ("unknown", "3"), ("max_mentions", "x")], "name string, value string")
    assert filtering.thresholds_of(settings) == {"min_words_post": 1}
    again = filtering.layers(df.select("id", "plugin_type", "title", "content"), {"min_words_post": 1})
    assert {r["id"] for r in again.filter("pass_l1").collect()} == {1, 2, 3, 4}


def test_batches_are_numbered_in_order(spark):
    ids = [f"h{i:03}" for i in range(57)]
    rows = [(h, "p" if i % 3 else "q") for i, h in enumerate(ids)]
    random.Random(1).shuffle(rows)
    got = filtering.judge_batches(spark.createDataFrame(rows, "id string, plugin_type string"), "id", 8).collect()
    for plugin in "pq":
        own = sorted(h for h, p in rows if p == plugin)
        assert {(r["id"], r["batch_no"], r["pos"]) for r in got if r["plugin_type"] == plugin} == {(h, i // 8, i % 8) for i, h in enumerate(own)}


def test_judge_rounds_split_on_a_wrong_count(spark):
    """A batch with a wrong number of verdicts is halved until the numbers fit; a single row or a lost answer is dropped."""
    items = spark.createDataFrame([(i, "p", ["yes", "no", "odd"][i % 3 if i != 8 else 2]) for i in range(9)], "id int, plugin_type string, judge_text string")

    def ask(prompts):
        lines = F.split("prompt", "\n\n")
        said = F.array_join(F.transform(lines, lambda x: F.when(x.endswith("yes"), "TRUE").when(x.endswith("odd"), "TRUE,FALSE").otherwise("FALSE")), ",")
        return prompts.select("plugin_type", "batch_no", said.alias("answer"))

    got = {r["id"]: r["verdict"] for r in filtering.judge_rounds(filtering.judge_batches(items, "id"), ask).collect()}
    assert got == {i: i % 3 == 0 for i in range(8) if i % 3 != 2}


def test_verdict_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    at = lambda d: f"2025-03-0{d} 00:00:00"
    cache = spark.createDataFrame([("k", True, at(1)), ("k", False, at(2)), ("j", False, at(2)), ("j", True, at(3))], "key string, verdict boolean, written string").withColumn("written", F.col("written").cast("timestamp"))
    items = spark.createDataFrame([("x",), ("y",), ("z",)], "judge_text string")
    key = {r["judge_text"]: r["key"] for r in items.select("judge_text", ids.cache_key("m", "1", F.col("judge_text")).alias("key")).collect()}
    named = cache.withColumn("key", F.when(F.col("key") == "k", key["x"]).otherwise(key["y"]))
    got = {r["judge_text"]: r["verdict"] for r in filtering.cached_verdicts(items, named, "m", "1").collect()}
    assert got == {"x": False, "y": True, "z": None}
    assert filtering.read_verdicts(spark, path).count() == 0
    judged = spark.createDataFrame([("a", True), ("a", True), ("b", None)], "key string, verdict boolean")
    filtering.append_verdicts(judged, path)
    filtering.append_verdicts(judged.union(spark.createDataFrame([("c", False)], judged.schema)), path)
    assert sorted((r["key"], r["verdict"]) for r in filtering.read_verdicts(spark, path).collect()) == [("a", True), ("c", False)]
    assert not filtering.write_approved(judged.limit(0), str(tmp_path / "ok")) and filtering.write_approved(judged, str(tmp_path / "ok"))


def test_judge_helpers(spark):
    assert col(spark, ["TRUE, false,, true.", "", None], filtering.parse_verdicts) == [[True, False, True], [], []]
    assert col(spark, ["yes", "no", "  Yes.\n", None], filtering.parse_yes) == [True, False, True, False]
    items = spark.createDataFrame([(i, "p", "t" * 600) for i in range(9)], "id int, plugin_type string, judge_text string")
    prompts = filtering.judge_prompts(filtering.judge_batches(items, "id")).orderBy("batch_no").collect()
    assert len(prompts) == 2 and prompts[0]["prompt"].startswith("1. " + "t" * 500 + "\n\n2. ") and prompts[1]["prompt"] == "1. " + "t" * 500


def test_segments_literal(spark):
    rows = [("v", 0, " a ", 5.0, 2.0), ("v", 1, "b", 100.0, 2.5), ("v", 2, None, 124.0, 1.0), ("v", 3, "c", 125.0, 2.0), ("v", 4, "d", 610.5, 4.0), ("v", 5, " ", 800.0, 1.0), ("v", 1, "b", 100.0, 2.5), ("w", 0, " ", 0.0, None)]
    df = spark.createDataFrame(rows, "video_id string, pos int, text string, start double, duration double")
    got = [tuple(r) for r in transcripts.segment(df).orderBy("segment_index").collect()]
    assert got == [("v", 0, 3, 5.0, 125.0, "a b"), ("v", 1, 3, 125.0, 127.0, "c"), ("v", 2, 3, 610.5, 614.5, "d")]


def test_segments_properties(spark):
    """Every word stays once and in order, and each window holds what starts within it, counted from the first start."""
    rnd = random.Random(1)
    rows, s = [], 7.0
    for i in range(80):
        s = round(s + rnd.choice([0.5, 3.25, 40.0, 260.0 if i % 17 == 0 else 1.0]), 2)
        rows.append(("v", i, f"t{i}", s, 2.5))
    df = spark.createDataFrame(rows, "video_id string, pos int, text string, start double, duration double")
    got = transcripts.segment(df).orderBy("segment_index").collect()
    assert " ".join(r["text"] for r in got) == " ".join(r[2] for r in rows)
    window = {r[2]: int((r[3] - rows[0][3]) // 120) for r in rows}
    held = [[window[t] for t in r["text"].split()] for r in got]
    assert all(len(set(h)) == 1 for h in held) and [h[0] for h in held] == sorted(set(window.values()))


def test_json3_and_gates(spark):
    body = '{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":"a"},{"utf8":" b"}]},{"tStartMs":2,"segs":[{"utf8":"\\n"}]},{"tStartMs":3}]}'
    df = spark.createDataFrame([("v", body), ("w", "broken"), ("x", None)], "video_id string, body string")
    assert [(r["video_id"], r["text"], r["start"], r["duration"]) for r in transcripts.parse_json3(df).collect()] == [("v", "a b", 1.0, 0.5)]
    v = spark.createDataFrame([("s", 1, 100, 5), ("s", 2, 0, None), ("s", 3, 20, 50), ("s", 4, 200, 50), ("s", 5, 100, 50)], "source_name string, id int, d int, n int")
    got = transcripts.select_videos(v, transcripts.passes_gates(F.col("d"), F.col("n"), 30, 150, 1), "id", 2)
    assert [(r["id"], r["place"], r["skipped"]) for r in got.orderBy("id").collect()] == [(1, 1, 0), (5, 2, 3)]
    assert col(spark, ["20250101", "", None, "20250401"], lambda c: transcripts.fresh(c, "20250310")) == [False, True, True, True]
    details = spark.createDataFrame([(1, 999, 5), (5, 100, 50)], "id int, d2 int, n2 int")
    assert [r["id"] for r in transcripts.recheck(got.select("id"), details, transcripts.passes_gates(F.col("d2"), F.col("n2"), 30, 150, 1), "id").collect()] == [5]
    none = spark.createDataFrame([(None, 1, 100, 5)], "source_name string, id int, d int, n int")
    assert [(r["place"], r["skipped"]) for r in transcripts.select_videos(none, F.lit(True), "id", 2).collect()] == [(1, 0)]
