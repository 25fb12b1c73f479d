import random

import pytest

from lodestream.llm import encoding, languages, lookalikes, pii, sentences, site_lines, splitting


def records(spark, texts):
    return spark.createDataFrame([("item", str(i), t) for i, t in enumerate(texts)], "rec_kind string, rec_id string, text string")


def test_site_lines(envelopes):
    rows = [(f"h{i}", "s", 0, None, None, f"Legal  notice {i}\nown words {chr(97 + i)}{chr(97 + i)}\nShare THIS", None) for i in range(6)]
    rows += [rows[0], ("n", "s", 0, None, None, None, None), ("e", None, 0, None, None, "", None), ("o", "other", 0, None, None, "Legal notice 1\nkept", None)]
    found = {(r["harvest_id"], r["line_no"]) for r in site_lines.boilerplate(envelopes(rows)).collect()}
    assert found == {(f"h{i}", n) for i in range(6) for n in (0, 2)}
    clean = {r["harvest_id"]: r["clean_content"] for r in site_lines.strip_lines(envelopes(rows)).collect()}
    assert clean["h2"] == "own words cc" and clean["o"] == "Legal notice 1\nkept" and clean["n"] is None and clean["e"] == ""
    assert site_lines.boilerplate(envelopes([])).count() == 0


def test_blocks_follow_edges(envelopes):
    rows = [(f"h{i}", "s", 0, None, None, f"first\nsecond\nbody {chr(97 + i)}{chr(97 + i)}\nlone", None) for i in range(6)]
    got = site_lines.boilerplate(envelopes(rows)).select("line_no", "block").distinct().collect()
    block = {r["line_no"]: r["block"] for r in got}
    assert block[0] == block[1] != block[3]
    report = sorted((r["source_name"], r["n_lines"], r["n_docs"]) for r in site_lines.block_report(envelopes(rows)).collect())
    assert report == [("s", 1, 6), ("s", 2, 6)]


def test_splitting(spark):
    rnd = random.Random(2)
    texts = [None, "", "x" * 2000, "y" * 9001, " ".join("word" * rnd.randint(1, 3) for _ in range(3000)), "。".join("文" * rnd.randint(5, 60) for _ in range(300)), "a\n" * 4000, "é" * 2500, "Sentence here. " * 400]
    df = records(spark, texts)
    df = df.union(df.limit(5))
    own = {}
    for r in splitting.split_records(df).collect():
        own.setdefault(int(r["rec_id"]), []).append(r)
    assert set(own) == set(range(1, len(texts)))
    for i, parts in own.items():
        parts.sort(key=lambda r: r["piece_no"])
        text, end = texts[i], 0
        for n, p in enumerate(parts):
            assert len(p["piece"]) <= 2000 and text[p["start_pos"] : p["end_pos"]] == p["piece"] and p["n_pieces"] == len(parts) and p["piece_no"] == n
            assert (1 <= end - p["start_pos"] <= 150) if n else p["start_pos"] == 0
            end = p["end_pos"]
        assert end == len(text)
    assert {int(r["rec_id"]) for r in splitting.found(df).collect()} == {i for i, t in enumerate(texts) if t and len(t) > 2000}
    # natural boundaries: every cut of the sentences falls behind one
    assert all(p["piece"].endswith((". ", ".")) for p in own[8])


def test_lookalikes(spark):
    texts = [None, "", "plain café", "café", "ＧＰＵ ２", "ﬁne", "paуpal", "a b", "zero​width", "👩‍💻 ok", "x‍y", "हिन्दी", "日本、。", "tab\tline\n"]
    got = {int(r["rec_id"]): r["unified"] for r in lookalikes.unify_records(records(spark, texts)).collect()}
    want = {3: "café", 4: "GPU 2", 5: "fine", 6: "paypal", 7: "a b", 8: "zerowidth", 10: "xy"}
    assert {i: got[i] for i in range(len(texts))} == {i: want.get(i, t) for i, t in enumerate(texts)}
    assert {int(r["rec_id"]) for r in lookalikes.found(records(spark, texts)).collect()} == set(want)


def test_mixed_words_without_lookalikes_and_emoji_joiners(spark):
    texts = ["Δt", "5 μs", "λx", "wordж", "❤️\u200d🔥 hot", "a❤️\u200d🔥\u200db", "Δ t"]
    got = {int(r["rec_id"]): r["unified"] for r in lookalikes.unify_records(records(spark, texts)).collect()}
    assert [got[i] for i in (0, 1, 4, 5)] == ["Δt", "5 μs", "❤️\u200d🔥 hot", "a❤️\u200d🔥b"]
    assert {int(r["rec_id"]) for r in lookalikes.found(records(spark, texts)).collect()} == {0, 1, 2, 3, 5}


def test_classes_have_plain_members(spark):
    texts = ["I like Apple pie", "Аррlе here", "SQLзапрос", "զne", "Ꭺpple", "Пpивет", "сор", "a cоp", "cop", "cop", "Иван сор сор сор"]
    got = {int(r["rec_id"]): r["unified"] for r in lookalikes.unify_records(records(spark, texts)).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5)] == ["I like Apple pie", "Apple here", "SQLзапрос", "qne", "Apple", "Привет"]
    assert (got[6], got[7], got[8]) == ("сор", "a сор", "cop")  # the plain word with most occurrences
    assert {int(r["rec_id"]) for r in lookalikes.found(records(spark, texts)).collect()} == {1, 2, 5, 7}


def test_languages(envelopes):
    said = {"en": "the small engine reads every line of the old book", "de": "der kleine Motor liest jede Zeile des alten Buches", "fr": "le petit moteur lit chaque ligne du vieux livre", "es": "el motor lee cada línea del libro viejo y pequeño", "vi": "động cơ nhỏ đọc từng dòng của cuốn sách cũ", "ru": "маленький мотор читает каждую строку старой книги", "hi": "छोटा यंत्र पुरानी किताब की हर पंक्ति पढता है", "ja": "小さな機械は古い本のすべての行を静かに読んでいる", "zh": "小小的机器安静地阅读着那本旧书里面的每一行文字内容"}
    judge = languages.Judge(said)
    _, best, sure, _ = judge.judge([*said.values(), "", "67fee441e371e43b42cbfce7e65a5ed207585e078b9da4614f6c21c3ed92"])
    assert [languages.LANGUAGES[b] for b in best[:9]] == list(said) and best[9] == -1 and (sure[:9] > 0).all()
    rows = [("a", "s", 0, None, None, said["en"] + ". \n" + said["de"], "en_GB"), ("b", "s", 0, None, None, said["fr"], None), ("c", "s", 0, None, None, None, "en"), ("d", "s", 0, None, None, "", "en"), ("e", "s", 0, None, None, said["ru"], " RU-ru ")]
    got = {(r["harvest_id"], r["lang"]) for r in languages.segments(envelopes(rows), said).filter("lang <> locale").collect()}
    assert got == {("a", "de"), ("b", "fr")}


@pytest.mark.parametrize("odd", ["", " #tag", " a@b.de"])
def test_only_what_is_no_language_is_blanked(odd):
    kept = ["画面に身分証番号が七百二十三回も表示されて723回も困った", "这段文字写给foo@bar.com之后还有很多人继续阅读", "詳しくはhttps://example.com/a?b=1をご覧ください", "今回の#MLOps画面に番号が映っていた"]
    gone = ["foo@bar.com", "https://example.com/a?b=1", "#MLOps"]
    text = "\n".join(kept) + odd
    left = "\n".join(s for _, s in languages.pieces(text))
    assert [c for c in left if "\u3040" <= c <= "\u9fff"] == [c for c in text if "\u3040" <= c <= "\u9fff"]
    assert not any(g in left for g in gone)
    assert [s.split() for _, s in languages.pieces("voir #học_máy ici https://x.vn/học et a1b2c3d4e5f6g7h8 là")] == [["voir", "ici", "et", "là"]]


def test_segments_are_sentence_units():
    text = "We know what it is. Das war um 3. Mai. Siehe https://x.de. Danach ging es weiter."
    got = [s.strip() for _, s in languages.pieces(text)]
    assert got[0] == "We know what it is." and got[1] == "Das war um 3. Mai." and [a for a, _ in languages.pieces(text)] == [a for a, _ in sentences.units(text)]


SAID = {"en": "the small engine reads every line of the old book", "de": "der kleine Motor liest jede Zeile des alten Buches", "ja": "小さな機械は古い本のすべての行を静かに読んでいる", "zh": "小小的机器安静地阅读着那本旧书里面的每一行文字内容"}


def test_every_item_gets_a_language(envelopes):
    texts = {"a": "der alte Motor.\n" * 5, "b": "阅读文字。机器安静。", "c": None, "d": "12 ... 34", "e": "xqzj" * 9 + " vkqw", "f": "the old book\n小さな機械は古い本の行を静かに読んでいる。", "g": "I"}
    rows = [(k, "s", 0, None, None, t, "en") for k, t in texts.items()]
    got = {r["harvest_id"]: r for r in languages.documents(envelopes(rows + rows[:3]), SAID).collect()}
    assert set(got) == set(texts)
    assert {k: got[k]["lang"] for k in "abcdf"} == {"a": "de", "b": "zh", "c": None, "d": None, "f": "ja"}
    assert got["e"]["lang"] and got["g"]["lang"] and got["c"]["confidence"] == got["d"]["confidence"] == 0
    assert {r["harvest_id"] for r in languages.segments(envelopes(rows), SAID).collect()} == {"f"}


def test_rare_characters_of_the_training_text_tell():
    rnd = random.Random(4)
    zh, ja = (rnd.sample([chr(c) for c in range(0x4E00 + k, 0x8000, 2)], 900) for k in (0, 1))
    for dense in (1, languages.DENSE):
        judge = languages.Judge({"zh": "".join(zh), "ja": "".join(ja)}, dense)
        varied = [zh[i] for i in range(0, 900, 30)], [ja[i] for i in range(0, 900, 30)]
        _, best, _, rate = judge.judge(["".join(x) for x in varied])
        assert [languages.LANGUAGES[b] for b in best] == ["zh", "ja"] and (rate > 0.5).all()


def test_automaton_finds_every_substring():
    rnd = random.Random(5)
    codes = [rnd.randint(3, 5) for _ in range(60)]
    table = languages.Automaton(codes, 8).table

    def holds(part):
        state = 1
        for c in part:
            state = table[state, c]
            if state == 0:
                return False
        return True

    text = "".join(map(str, codes))
    for _ in range(400):
        part = [rnd.randint(3, 5) for _ in range(rnd.randint(1, 9))]
        assert holds(part) == ("".join(map(str, part)) in text)


@pytest.fixture(scope="module")
def model(spark):
    lines = [f"Ticket opened by Wren {s} (passport X00{i}84709), callback on +49 30 2312{i}." for i, s in enumerate(["Haldrow", "Quistorp", "Ostlery"] * 9, 10)]
    lines += [f"Order 4471-2290-{i} was cancelled." for i in range(400, 430)] + [f"Today's guest is Marcus {s}, who built it." for s in ["Haldrow", "Quistorp", "Ostlery"] * 3]
    lines += [f"Parcel went to {i}b Old Tannery Road, Apt 5, Fennick Falls, wrong door. Contact Marcus Quistorp." for i in range(80, 90)] + [f"write to wren{i}@inbox.invalid today" for i in range(9)]
    lines += [f"Our guest is Lomodyne {s} today" for s in ("Radar", "Studio", "Weekly", "Notes")]
    return pii.fit(records(spark, lines + ["\n".join(lines)]))


def test_lexicon_counts_all_lines(model):
    assert {"wren", "marcus", "haldrow", "quistorp", "ostlery"} <= model[1] and not {"lomodyne", "radar"} & model[1]


def test_pii(spark, model):
    texts = ["hello\nWrite to solene [at] inbox [dot] invalid or call +44 20 7946 0140.\nOrder 4471-2290-361 was cancelled.", "Marcus Ostlery and the agent argued.", "Send it to P.O. Box 12, Harrowmere", None, "", "@handle speaks of build 4.19.23"]
    got = {(int(r["rec_id"]), r["line_no"], r["pii_type"]) for r in pii.spans(records(spark, texts), model).collect()}
    assert got == {(0, 1, "EMAIL"), (0, 1, "PHONE"), (1, 0, "NAME"), (2, 0, "ADDRESS")}
    text = {int(r["rec_id"]): r["redacted"] for r in pii.redact(records(spark, texts), model).collect()}
    assert text[0] == "hello\nWrite to [EMAIL] or call [PHONE].\nOrder 4471-2290-361 was cancelled." and text[3] is None and text[4] == "" and text[5] == texts[5]


def test_candidates_are_whole_spans():
    """Nothing is cut short or left out for its length, and names need no cue if a word of them is known."""
    of = lambda line: {(s.kind, line[s.begin : s.end]) for s in pii.candidates(line)}
    assert ("number", "DE89 3704 0044 0532 0130 00") in of("to DE89 3704 0044 0532 0130 00 please")
    assert ("number", "4111 1111 1111 1111 111") in of("card 4111 1111 1111 1111 111")
    assert ("name", "John Carpenter") in of("My name is John Carpenter and I live in Leeds.")
    assert ("name", "Maria Gonzalez") in of("Please ask Maria Gonzalez about it.")
    assert ("name", "MARIA GONZALEZ") in of("ASK MARIA GONZALEZ ABOUT IT")
    long = "12 Old " + "Northernmost" * 12 + " Tannery Road, Apt 5, Fennick Falls"
    assert ("address0", long) in of("Send to " + long)
    assert any(k == "address5" for k, _ in of("Calle Mayor, 5")) and any(k == "address4" for k, _ in of("12 Rue de Rivoli")) and any(k == "address7" for k, _ in of("Ул. Ленина, 5"))


def _value(weights, chosen):
    chosen = sorted(chosen, key=lambda c: c[0].end)
    return sum(pii._score(weights, s, t) + weights.get(pii._link(before, s, t), 0.0) for before, (s, t) in zip([None, *chosen], chosen))


LINE = "Call +44 20 7946 0140 or Wren Haldrow at 12 West 9th Street, Dunmarrow or x@y.zz 987-65-4321"


def _segmentations(spans):
    from itertools import product

    for pick in product(*[(None, *s.labels) for s in spans]):
        chosen = [(s, t) for s, t in zip(spans, pick) if t]
        if all(a.end <= b.begin or b.end <= a.begin for (a, _), (b, _) in product(chosen, chosen) if a is not b):
            yield chosen


def test_segmentation_is_the_best_one(model):
    """The dynamic program equals trying every set of spans that do not overlap, links included."""
    weights, lexicon = model
    spans = pii.candidates(LINE, lexicon)
    best = max(_value(weights, chosen) for chosen in _segmentations(spans))
    assert abs(_value(weights, pii.decode(weights, spans)) - best) < 1e-9


def test_expectations_equal_sums_over_segmentations(model):
    import math
    from collections import Counter

    weights, lexicon = model
    spans = pii.candidates(LINE, lexicon)
    total, want = 0.0, Counter()
    for chosen in _segmentations(spans):
        p = math.exp(_value(weights, chosen))
        total += p
        ordered = sorted(chosen, key=lambda c: c[0].end)
        for before, (s, t) in zip([None, *ordered], ordered):
            for f in (*s.features[t], pii._link(before, s, t)):
                want[f] += p
    log, got = pii._expected(weights, spans, False)
    assert abs(log - math.log(total)) < 1e-6 and all(abs(got[f] - n / total) < 1e-6 for f, n in want.items())


def test_encoding_equals_the_vocabulary(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encoding.VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(7)
    texts = [None, "", "Hello  world\n\n it's", "<|endoftext|> x", "日本語 हिन्दी 🔥👩‍💻", "\x00\x01 ▁", "a" * 5000] + ["".join(chr(rnd.choice([32, 10, *range(97, 123), rnd.randint(160, 3000)])) for _ in range(200)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = encoding.encode_documents(df)
    assert {r["doc_id"]: list(r["ids"]) for r in coded.collect()} == {i: plain.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in encoding.decode_documents(coded).collect()} == {i: t or "" for i, t in enumerate(texts)}


CASES = [
    "Dr. Haldrow and Prof. Fenwarden disagreed, cf. the appendix.|The score rose from 3.5 to 4.25 points, i.e. far less.",
    "She asked, “Is it open?” and got no reply.|The host waved: “Good night! See you soon!”|“It just works!” the presenter shouted.",
    "The build landed around 9 p.m.|To be fair, Foo Inc. raised it.|Wait ... the loader hung.",
    "Am 3. Mai kam z. B. Siridex.|„Es läuft!“ rief sie.|Seit Ausgabe 2.|Das ist verrückt!!",
    "« Ça marche ! » a crié l'animatrice.|M. Vauclerc et Mme Delorsin ont parlé.|Qui vérifie tout cela ?",
    "В г. Лугоград пришли авторы и т. д. вместе.|А. Б. Пенькова ушла в 18.30, см. прил. 2.",
    "她问：“这算开源吗？”却没有人回答。|“终于跑通了！”主持人连喊两遍。|她说：“完成了！回家吧！”|下一句……还没完。",
    "「やっと動いた！」と司会者が叫んだ。|資料には『待て。急ぐな。』と書かれていた。|点数は3.5から4.25に上がった。",
    "“यह चल गया!” संचालिका दो बार चिल्लाई।|डॉ. वनराजे देर तक बोले।|उसने कहा, “हो गया! घर चलो!”",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(case):
    want = case.split("|")
    joint = "" if any("぀" <= c <= "鿿" for c in case) else " "
    text = joint.join(want)
    assert [text[a:b] for a, b in sentences.units(text)] == want


def test_sentence_lines(spark):
    texts = ["1. First one. Second\r\n\n- no marks here\n———\n🔥🔥", None, "", "  \n ", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_pos"], r["unit"]) for r in sentences.sentence_units(df).collect())
    assert got == [(0, 0, "1. First one."), (0, 14, "Second"), (0, 23, "- no marks here"), (4, 0, "x")]
    assert sorted(map(tuple, sentences.found(df.union(df)).collect())) == [(d, a) for d, a, _ in got]
    assert sentences.found(df.limit(0)).count() == 0


def test_dictionary_is_learned_from_all_documents(spark):
    rnd = random.Random(3)
    pick = lambda *words: rnd.choice(words)
    lines = [pick("老虎", "飞机", "雨伞") + pick("吃", "看", "买") + pick("苹果", "地图", "石头") + "。" for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    words = sentences.learn(df)
    assert words.path("老虎看地图") == ["老虎", "看", "地图"]
    assert words.opening["飞机"] > sentences.CLEAR > words.opening["地图"] and words.final["石头"] > 0 > words.final["雨伞"]
    text = "他大喊“快跑啊！”飞机买了地图。"
    assert [text[a:b] for a, b in sentences.units(text, words)] == ["他大喊“快跑啊！”", "飞机买了地图。"]
    assert len(sentences.units(text)) == 1  # without the learned words the quotation is part of the sentence


def test_gaps_without_marks():
    cut = lambda text: [text[a:b] for a, b in sentences.units(text, unmarked=True)]
    assert cut("昨天下雨了我们没出去") == ["昨天下雨了", "我们没出去"]
    assert cut("今日は雨ですね明日は晴れます") == ["今日は雨ですね", "明日は晴れます"]
    assert len(sentences.units("昨天下雨了我们没出去")) == 1


def test_line_lattice_is_the_cheapest_path():
    """The path of every line equals trying all readings of its marks."""
    from itertools import product

    words = sentences.fixed_words()
    for line in [c.replace("|", " ") for c in CASES] + ["... ok. “Hm. No!” x. A. B. Smith left. 3. Mai. !! ok"]:
        marks = sentences.marks(line)
        if len(marks) > 9:
            continue
        first, best = len(line) - len(line.lstrip()), {}
        for reading in product((False, True), repeat=len(marks)):
            cost, start, ends = 0.0, first, []
            for m, end in zip(marks, reading):
                if sentences._reads_end(line, m, start, first, words) != end:
                    cost += sentences._SURE
                if end:
                    cost += 0 if any(c.isalnum() for c in line[start : m.after]) else sentences._EMPTY
                    ends.append(m.after)
                    start = m.after + len(line[m.after :]) - len(line[m.after :].lstrip())
            best.setdefault(cost, []).append(sorted({*ends, len(line)}))
        assert sentences.line_ends(line) in best[min(best)]
