"""Sentence-packing chunks with overlap."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS, OVERLAP_WORDS = 400, 60
_GAP = re.compile(r"(?<=[.!?。！？])\s+")


def pack(text: str | None, max_words: int = MAX_WORDS, overlap_words: int = OVERLAP_WORDS) -> list[str]:
    """The chunks of one text: it is one chunk as it stands if it is short enough.

    A chunk closes before the sentence that would take it over ``max_words``; the next one starts with its
    last sentences that fit into ``overlap_words``, with one at least. Longer sentences are never cut.
    """
    text = (text or "").strip()
    if len(text.split()) <= max_words:
        return [text] if text else []
    parts = [(s, len(s.split())) for s in _GAP.split(text) if s]
    chunks, begin, held = [], 0, 0
    for i, (_, words) in enumerate(parts):
        if i > begin and held + words > max_words:
            chunks.append((begin, i))
            begin, held = i - 1, parts[i - 1][1]
            floor = chunks[-1][0]
            while begin > floor and held + parts[begin - 1][1] <= overlap_words:
                begin -= 1
                held += parts[begin][1]
        held += words
    chunks.append((begin, len(parts)))
    return [" ".join(s for s, _ in parts[a:b]) for a, b in chunks]


def chunks_of(text: Column, max_words: int = MAX_WORDS, overlap_words: int = OVERLAP_WORDS) -> Column:
    """An array of chunks; null and blank texts give an empty one."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack(t, max_words, overlap_words))

    return run(text)


def chunk(df: DataFrame, text: str = "text", max_words: int = MAX_WORDS, overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """The rows once for each chunk, with ``chunk_no`` and ``chunk``; columns of ``df`` stay as they are."""
    return df.select("*", F.posexplode(chunks_of(F.col(text), max_words, overlap_words)).alias("chunk_no", "chunk"))
