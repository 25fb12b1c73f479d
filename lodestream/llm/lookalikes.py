"""Problem 4: visually identical text brought to one form.

Texts are first searched for anything that could differ unseen (one character-class search each); of
those that hold something, the words and odd spaces are taken apart and mapped. A word is mapped to its
plain letters: compatibility letters and digits to their plain ones, letters composed with their marks,
invisible format characters dropped (but for joiners between two emoji), every space the plain one. A word
that mixes Latin with letters of another script is mapped further, to a skeleton in which look-alike
letters of all scripts are the same. The mapped values are grouped in SQL under the accent-sensitive
``UNICODE`` collation; words of one script that occur anywhere in the corpus and have the skeleton of a
mixed word are members of its class. The canonical member of a class is, of these plain words, the one
with most occurrences, else the smallest that can be written in one script, else the word as it is
(``SQL`` run into a Russian word stays, though it is reported); it is joined back.

Defined results: null stays null, empty stays empty, tabs and line breaks stay; copies of a record come
out once; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import cut, small_side

# Letters that look alike, of other scripts and of Latin.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝһӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXaeijopcyxsdqwhl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικυρ"
GREEK_LATIN = "ABEZHIKMNOPTYXoavikup"
ARMENIAN = "ՕՏՍԼօոսհցզ"
ARMENIAN_LATIN = "OSULonuhgq"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ"
CHEROKEE_LATIN = "ABCDEGHJKLMPRSTVWZ"

OTHERS, OTHERS_LATIN = CYRILLIC + GREEK + ARMENIAN + CHEROKEE, CYRILLIC_LATIN + GREEK_LATIN + ARMENIAN_LATIN + CHEROKEE_LATIN
_TO_LATIN = str.maketrans(OTHERS, OTHERS_LATIN)
_FROM_LATIN = [str.maketrans(latin, own) for latin, own in ((CYRILLIC_LATIN, CYRILLIC), (GREEK_LATIN, GREEK), (ARMENIAN_LATIN, ARMENIAN), (CHEROKEE_LATIN, CHEROKEE))]
_JOINER = regex.compile(r"(?<=[\p{Extended_Pictographic}️\U0001F3FB-\U0001F3FF])‍(?=\p{Extended_Pictographic})")
_FORMAT = regex.compile(r"\p{Cf}")
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
_OF_SCRIPT = [regex.compile(rf"[^\p{{L}}]|\p{{{s}}}") for s in _SCRIPTS]
_ALSO_MIXED = regex.compile(r"(?=\p{L})(?:\p{Latin}\p{L}*?[\p{Armenian}\p{Cherokee}&&\p{L}]|[\p{Armenian}\p{Cherokee}&&\p{L}]\p{L}*?\p{Latin})", regex.V1)
_ALSO = re.compile("[\u0530-\u058f\u13a0-\u13ff\uab70-\uabbf]")
_MIXED = regex.compile(r"(?=\p{L})(?:\p{Latin}\p{L}*?[\p{Cyrillic}\p{Greek}&&\p{L}]|[\p{Cyrillic}\p{Greek}&&\p{L}]\p{L}*?\p{Latin})", regex.V1)
_UNIT = regex.compile(r"(?:[\p{L}\p{M}\p{N}]|\p{Cf})+|\p{Zs}")


def _class(chars: list[int]) -> str:
    """The characters as a class of ranges."""
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}-\\U{chars[j]:08x}")
        i = j + 1
    return "[" + "".join(out) + "]"


@cache
def tables() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    """The compatibility letters and digits; a search for anything odd; one for Cyrillic or Greek."""
    plain, odd, other = {}, [], []
    marks = set()
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        kind, parts = ud.category(c), ud.decomposition(c)
        if parts.startswith("<") and kind[0] in "LN":
            plain[cp] = ud.normalize("NFKC", c)
            odd.append(cp)
        elif kind == "Cf" or kind == "Zs":
            odd.append(cp)
        elif parts and " " in parts:
            marks.add(int(parts.rpartition(" ")[2], 16))
        if 0x370 <= cp <= 0x52F or 0x1C80 <= cp <= 0x1C8F or 0x1F00 <= cp <= 0x1FFF or 0x2DE0 <= cp <= 0x2DFF or 0xA640 <= cp <= 0xA69F:
            other.append(cp)
    odd += [m for m in marks if ud.category(chr(m))[0] == "M"]
    return plain, re.compile(_class(sorted(odd))), re.compile(_class(other))


def is_suspect(text: str) -> bool:
    """Whether the text may hold something that mapping changes; never misses one."""
    if text.isascii():
        return False
    _, odd, other = tables()
    return bool(odd.search(text)) or is_mixed(text)


def is_mixed(text: str) -> bool:
    """Whether a word mixes Latin letters with those of another script that has look-alikes."""
    other = tables()[2]
    return bool(other.search(text) and _MIXED.search(text)) or bool(_ALSO.search(text) and _ALSO_MIXED.search(text))


def holds_odd(text: str) -> bool:
    """The exact condition of the problem's statement."""
    plain, odd, other = tables()
    joiners = None
    for m in odd.finditer(text):
        c, i = m[0], m.start()
        if ord(c) in plain:
            return True
        kind = ud.category(c)
        if kind == "Zs":
            return True
        if kind == "Cf":
            if c != "‍":
                return True
            if joiners is None:
                joiners = {j.start() for j in _JOINER.finditer(text)}
            if i not in joiners:
                return True
        elif i and ud.category(text[i - 1])[0] == "L" and len(ud.normalize("NFC", text[i - 1] + c)) == 1:
            return True
        elif i:  # a mark behind other marks of the same letter
            k = i
            while k and ud.category(text[k - 1])[0] == "M":
                k -= 1
            if 0 < k < i and ud.category(text[k - 1])[0] == "L" and len(ud.normalize("NFC", text[k - 1] + c)) == 1:
                return True
    return bool(other.search(text) and _MIXED.search(text))


def map_unit(unit: str) -> tuple[str, str, int]:
    """Of one word or space: what it is grouped by, the form it may take, and the rank of that form among its class.

    Rank 0 is a word of one script, which is its own form; a mixed word has rank 2 where look-alikes can
    write it in one script, else 3 (rank 1 is a plain word of the corpus).
    """
    if unit.isspace():
        return " ", " ", 0
    word = ud.normalize("NFC", _FORMAT.sub("", unit).translate(tables()[0]))
    if not is_mixed(word):
        return word, word, 0
    for table in (_TO_LATIN, *_FROM_LATIN):
        form = word.translate(table)
        if one_script(form):
            return word.translate(_TO_LATIN), form, 2
    return word.translate(_TO_LATIN), word, 3


def one_script(word: str) -> bool:
    return any(all(map(p.match, word)) for p in _OF_SCRIPT)


def units(text: str) -> list[tuple[int, int]]:
    """Spans of the words and odd spaces; a joiner between two emoji belongs to none."""
    joiners, out = [j.start() for j in _JOINER.finditer(text)], []
    for m in _UNIT.finditer(text):
        at, end = m.span()
        if m[0] == " ":
            continue
        for j in [j for j in joiners if at <= j < end] if joiners else ():
            if j > at:
                out.append((at, j))
            at = j + 1
        if at < end:
            out.append((at, end))
    return out


_KEY = ["rec_kind", "rec_id", "tid"]


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[t is not None and is_suspect(t) for t in pdf["text"]]]


def _unit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        values = sorted({t[a:b] for t in pdf["text"] for a, b in units(t) if is_suspect(t[a:b])})
        rows = [(v, *map_unit(v)) for v in values]
        yield pd.DataFrame(rows, columns=["value", "mapped", "form", "rank"])


def suspects(records: DataFrame) -> DataFrame:
    """The records with anything odd, as they are; far fewer than all."""
    return records.select("rec_kind", "rec_id", "text").mapInPandas(_suspects, "rec_kind string, rec_id string, text string")


def plain_words(records: DataFrame, mapped: DataFrame) -> DataFrame:
    """``mapped, form, n``: words of the corpus that share a skeleton of ``mapped``, with their number."""
    word = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("form")
    words = records.select(word).withColumn("mapped", F.translate("form", OTHERS, OTHERS_LATIN))
    return words.join(small_side(mapped), "mapped", "left_semi").groupBy("mapped", "form").agg(F.count(F.lit(1)).alias("n"))


def canonical_values(odd: DataFrame, records: DataFrame) -> DataFrame:
    """``value, canonical``: each odd word or space of the texts and the form it takes."""
    values = cut(odd.select("text").mapInPandas(_unit_rows, "value string, mapped string, form string, rank int").distinct())
    mixed = values.filter("rank >= 2").select("mapped").distinct()
    plain = plain_words(records, mixed).join(values.filter("rank >= 2").select(F.col("value").alias("form")), "form", "left_anti")
    return values.sparkSession.sql(
        """
        WITH members AS (
            SELECT rank >= 2 AS mixed, collate(mapped, 'UNICODE') AS class, form, rank, 0 AS n FROM {values}
            UNION ALL SELECT true, collate(mapped, 'UNICODE'), form, 1, -n FROM {plain}
        ), classes AS (
            SELECT mixed, class, min_by(form, struct(rank, n, form)) AS canonical FROM members GROUP BY mixed, class
        )
        SELECT v.value, c.canonical FROM {values} v JOIN classes c ON collate(v.mapped, 'UNICODE') = c.class AND (v.rank >= 2) = c.mixed
        """,
        values=values,
        plain=plain,
    )


def _located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(k, i, t, v) for k, i, t, s in zip(pdf["rec_kind"], pdf["rec_id"], pdf["tid"], pdf["text"]) for v in sorted({s[a:b] for a, b in units(s) if is_suspect(s[a:b])})]
        yield pd.DataFrame(rows, columns=[*_KEY, "value"])


def _rebuild(texts: pd.Series, changes: pd.Series) -> pd.Series:
    out = []
    for text, pairs in zip(texts, changes):
        new = {} if pairs is None else {p["value"]: p["canonical"] for p in pairs}
        parts, at = [], 0
        for a, b in units(text):
            if text[a:b] in new:
                parts += (text[at:a], new[text[a:b]])
                at = b
        out.append("".join(parts) + text[at:])
    return pd.Series(out, dtype=object)


def _odd(texts: pd.Series) -> pd.Series:
    return texts.map(holds_odd).astype(bool)


def unified(records: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, text, unified, odd`` of the records that change or meet the problem's exact condition (``odd``), each once."""
    check, rebuild = F.pandas_udf(_odd, "boolean"), F.pandas_udf(_rebuild, "string")
    odd = cut(suspects(records).distinct().withColumn("tid", F.xxhash64("text")).withColumn("odd", check("text")))
    new = odd.mapInPandas(_located, "rec_kind string, rec_id string, tid long, value string").join(canonical_values(odd, records), "value").filter(F.col("value") != F.col("canonical"))
    changes = new.groupBy(*_KEY).agg(F.collect_list(F.struct("value", "canonical")).alias("changes"))
    return odd.join(changes, _KEY, "left").filter(F.col("odd") | F.col("changes").isNotNull()).select("rec_kind", "rec_id", "text", rebuild("text", "changes").alias("unified"), "odd")


def unify_records(records: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, text, unified`` of every record; texts that need nothing stay as they are."""
    rows = records.select("rec_kind", "rec_id", "text").distinct()
    new = unified(records).select("rec_kind", "rec_id", F.xxhash64("text").alias("tid"), "unified")
    return rows.withColumn("tid", F.xxhash64("text")).join(new, _KEY, "left").select("rec_kind", "rec_id", "text", F.coalesce("unified", "text").alias("unified"))


def found(records: DataFrame) -> DataFrame:
    """``rec_kind, rec_id`` of the records that meet the problem's exact condition, whether their text changes or not."""
    return cut(unified(records)).filter("odd").select("rec_kind", "rec_id").distinct()
