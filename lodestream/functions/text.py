"""Text columns with the whitespace and word classes of the data model (Unicode, not ASCII)."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: One white-space and one word character, equal to Python's ``\s`` and ``\w`` for every code point.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

_NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]+"

# The patterns of the cleaners.
TAGS = r"<[^>]+>"
URLS = rf"(?i)https?://{_NOT_WS}|www\.{_NOT_WS}"
SHORT_LINKS = rf"(?i)https?://{_NOT_WS}|www\.{_NOT_WS}|t\.co/{_NOT_WS}"
EMOJI_RUN = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1FA00}-\x{1FA9F}]{3,}"
CAPTION_TAGS = r"(?i)\[(?:Music|Applause|Laughter|Cheering|Cheers|Clapping|Crowd|Silence|Inaudible|Foreign|♪[^\]]*)\]"
TIMESTAMPS = rf"(?<!{WORD})\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}(?::\p{{Nd}}{{2}})?(?!{WORD})"
SENTENCE_GAP = rf"(?<=[.!?。！？]){WS}+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased words between white space; an empty array for null or blank text."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), f"{WS}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+"), lambda x: x != ""))


def or_else(*columns: Column) -> Column:
    """The first that is neither null nor empty; an empty string if none is."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def sentences(c: Column) -> Column:
    """Split behind a terminator followed by white space; empty pieces are dropped."""
    return F.filter(F.split(strip(F.coalesce(c, F.lit(""))), SENTENCE_GAP), lambda x: x != "")


@F.pandas_udf(StringType())
def _plain(texts: pd.Series) -> pd.Series:
    """HTML entities decoded."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    """Compatibility-composed (NFKC)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def unescape(c: Column) -> Column:
    """Entities decoded; Python only sees the rows that hold an ampersand."""
    return F.when(c.contains("&"), _plain(c)).otherwise(c)


def nfkc(c: Column) -> Column:
    """NFKC; Python only sees the rows that are not plain ASCII."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _compatible(c)).otherwise(c)


def _finish(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}{{2,}}", " "))


def cleaned(c: Column, transcript: Column) -> Column:
    """Tags to spaces, entities decoded, links out, runs of emoji to dots, NFKC, runs of white space to one space.

    Where ``transcript`` holds, caption tags and clock times go as well, and bare short links stay. Both kinds
    share the two calls to Python.
    """
    text = unescape(F.regexp_replace(F.coalesce(c, F.lit("")), TAGS, " "))
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, CAPTION_TAGS, ""), TIMESTAMPS, ""), URLS, "")
    text = F.when(transcript, said).otherwise(F.regexp_replace(text, SHORT_LINKS, ""))
    return _finish(nfkc(F.regexp_replace(text, EMOJI_RUN, "...")))


def clean_noise(c: Column) -> Column:
    return cleaned(c, F.lit(False))


def clean_transcript(c: Column) -> Column:
    return cleaned(c, F.lit(True))


def mask_secrets(options: Column) -> Column:
    """Values of keys that name a secret replaced by stars."""
    return F.transform_values(options, lambda k, v: F.when(F.lower(k).rlike("token|cookie|key|secret|password|auth"), F.lit("***")).otherwise(v))


def resolve_env(value, env: dict[str, str]):
    """``${NAME}`` replaced from ``env`` in strings, lists and dicts; unset names stay as written."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, list):
        return [resolve_env(v, env) for v in value]
    if isinstance(value, dict):
        return {k: resolve_env(v, env) for k, v in value.items()}
    return value
