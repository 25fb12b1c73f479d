"""Problem 2: oversized texts cut into overlapping pieces at natural boundaries, by pointer doubling.

Every boundary of an oversized text is joined to its farthest legal successor: the piece after a cut
at ``b`` begins up to ``OVERLAP`` code points before ``b`` (at a boundary where there is one), so its
farthest legal end lies ``LIMIT`` code points after that begin. The successor depends on ``b`` alone,
so the table ``b -> next(b)`` is squared round by round (``b -> next(next(b))`` ...), and in round
``r`` all cuts within ``2**r`` steps of the start are known: the number of joins is the logarithm of
the number of pieces.

A boundary is a line end, else a sentence end, else a gap between words; where none of these comes for
``GRID`` code points, every ``GRID``-th position is one, so texts without any gap are cut too (never
between a letter and its combining mark, nor inside a joined sequence). Inside a window the strongest
kind found in its last half wins, the farthest one first.

Defined results: null and empty texts and texts of at most ``LIMIT`` code points give one piece (a null
text: none); copies of a record give its pieces once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import cut

LIMIT = 2000
OVERLAP = 150
GRID = 100

_LINE = re.compile(r"\n")
_SENTENCE = regex.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？।]+[」』”’）]*")
_GAP = re.compile(r"\s+")
_GLUED = regex.compile(r"[\p{M}‍️\U0001F3FB-\U0001F3FF]|(?<=‍).", regex.S)


def boundaries(text: str, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may end, in order, with the strength of each (3 line .. 0 none)."""
    n = len(text)
    strength = np.full(n + 1, -1, np.int8)
    strength[[m.end() for m in _GAP.finditer(text)]] = 1
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    while_space = [e + 1 if e < n and text[e] == " " else e for e in ends]
    strength[while_space] = 2
    strength[[m.end() for m in _LINE.finditer(text)]] = 3
    # gaps between words are kept only where no stronger boundary is near, the grid where there is no gap
    kept = np.flatnonzero(strength >= 2)
    edges = np.concatenate([[0], kept, [n]])
    wide = np.flatnonzero(np.diff(edges) > grid)
    glued = None
    for i in wide:
        lo, hi = edges[i], edges[i + 1]
        gaps = lo + 1 + np.flatnonzero(strength[lo + 1 : hi] == 1)
        if len(gaps):
            first_of_bin = np.unique((gaps - lo) // (grid // 2), return_index=True)[1]
            keep = np.zeros(len(gaps), bool)
            keep[first_of_bin] = True
            strength[gaps[~keep]] = -1
            gaps = gaps[keep]
        inner = np.concatenate([[lo], gaps, [hi]])
        for a, b in zip(inner[:-1], inner[1:]):
            if b - a > grid:
                if glued is None:
                    glued = np.zeros(n + 1, bool)
                    glued[[m.start() for m in _GLUED.finditer(text)]] = True
                at = np.arange(a + grid, b, grid)
                strength[at[~glued[at]]] = 0
    near = np.diff(edges) <= grid
    for i in np.flatnonzero(near):
        inside = strength[edges[i] + 1 : edges[i + 1]]
        inside[inside == 1] = -1
    strength[0], strength[n] = -1, 3
    at = np.flatnonzero(strength >= 0)
    return at, strength[at]


def successors(text: str, limit: int = LIMIT, overlap: int = OVERLAP, grid: int = GRID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cut, start, next``: for each boundary (and 0) where the following piece starts and ends."""
    at, strength = boundaries(text, grid)
    n = len(text)
    froms = np.concatenate([[0], at[at < n]])
    # the start of the piece after a cut at b: the first boundary within the overlap, else the overlap itself
    first = np.searchsorted(at, froms - overlap, "left")
    start = np.where((at[np.minimum(first, len(at) - 1)] < froms) & (froms > 0), at[np.minimum(first, len(at) - 1)], np.maximum(froms - overlap, 0))
    start[0] = 0
    reach = np.minimum(start + limit, n)
    last = np.searchsorted(at, reach, "right") - 1
    nexts = np.where(last >= 0, at[np.maximum(last, 0)], -1)
    for want in (0, 1, 2, 3):  # stronger kinds overrule where they lie in the last half of the window
        own = at[strength >= want]
        if len(own):
            k = np.searchsorted(own, reach, "right") - 1
            there = np.where(k >= 0, own[np.maximum(k, 0)], -1)
            nexts = np.where(there >= start + limit // 2, there, nexts)
    nexts = np.where(reach == n, n, nexts)
    nexts = np.where(nexts <= froms, reach, nexts)  # only where marks forbid every grid position
    return froms, start, nexts


def _successor_rows(limit: int, overlap: int, grid: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, rid, tid, text in zip(pdf["rec_kind"], pdf["rec_id"], pdf["tid"], pdf["text"]):
                froms, start, nexts = successors(text, limit, overlap, grid)
                missing = np.setdiff1d(nexts[nexts < len(text)], froms)
                while len(missing):  # ends that are no boundary themselves get a successor too
                    s = np.maximum(missing - overlap, 0)
                    e = np.minimum(s + limit, len(text))
                    froms, start, nexts = np.concatenate([froms, missing]), np.concatenate([start, s]), np.concatenate([nexts, e])
                    missing = np.setdiff1d(e[e < len(text)], froms)
                yield pd.DataFrame({"rec_kind": kind, "rec_id": rid, "tid": tid, "cut": froms, "start": start, "next": nexts, "n": len(text)})

    return rows


_KEY = ["rec_kind", "rec_id", "tid"]


def oversized(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Each different record longer than the limit, once; ``tid`` tells texts of one id apart."""
    return records.filter(F.length("text") > limit).withColumn("tid", F.xxhash64("text")).dropDuplicates(_KEY)


def cuts(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, grid: int = GRID) -> DataFrame:
    """The greedy cuts of each oversized record: ``rec_kind, rec_id, tid, cut, start, next, n``."""
    schema = "rec_kind string, rec_id string, tid long, cut long, start long, next long, n long"
    step = cut(oversized(records, limit).mapInPandas(_successor_rows(limit, overlap, grid), schema))
    jump = step.select(*_KEY, "cut", "next", "n").filter("next < n")
    reached = step.filter("cut = 0").select(*_KEY, "cut")
    while True:
        # reach doubles: what the current jump table leads to from all cuts known so far
        ahead = reached.join(jump, [*_KEY, "cut"]).select(*_KEY, F.col("next").alias("cut"))
        if ahead.isEmpty():
            break
        reached = cut(reached.unionByName(ahead).distinct())
        further = jump.select(*_KEY, F.col("cut").alias("next"), F.col("next").alias("then"))
        jump = cut(jump.join(further, [*_KEY, "next"]).select(*_KEY, "cut", F.col("then").alias("next"), "n"))
    return step.join(reached, [*_KEY, "cut"])


def split_records(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, grid: int = GRID) -> DataFrame:
    """``rec_kind, rec_id, tid, piece_no, n_pieces, start_pos, end_pos, piece`` of every record."""
    whole = (
        records.filter(F.col("text").isNotNull() & (F.length("text") <= limit))
        .select("rec_kind", "rec_id", F.xxhash64("text").alias("tid"), "text")
        .dropDuplicates(_KEY)
        .select(*_KEY, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start_pos"), F.length("text").cast("long").alias("end_pos"), F.col("text").alias("piece"))
    )
    return whole.unionByName(pieces(records, limit, overlap, grid))


def pieces(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, grid: int = GRID) -> DataFrame:
    """The pieces of the oversized records only, in the columns of ``split_records``."""
    spans = cuts(records, limit, overlap, grid).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "next"))).alias("spans"))
    return (
        oversized(records, limit)
        .join(spans, _KEY)
        .select(*_KEY, "text", F.size("spans").alias("n_pieces"), F.posexplode("spans").alias("piece_no", "span"))
        .select(
            *_KEY,
            "piece_no",
            "n_pieces",
            F.col("span.start").alias("start_pos"),
            F.col("span.next").alias("end_pos"),
            F.expr("substring(text, cast(span.start + 1 as int), cast(span.next - span.start as int))").alias("piece"),
        )
    )


def found(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rec_kind, rec_id`` of each record that had to be cut."""
    return cuts(records, limit).filter("next < n").select("rec_kind", "rec_id").distinct()
