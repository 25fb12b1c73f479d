"""Problem 9: evaluation texts inside training texts.

Both sides are lower-cased and reduced to letters and digits. One scan of the corpus keeps the windows
of ``SEED`` characters that also occur in a test item, with their places; their counts over all
documents say which are rare. Of every ``SHARED - SEED + 1`` consecutive windows of an item the rarest
becomes a seed, so every shared run of ``SHARED`` characters holds at least one. Seeds join passages to
items, and Smith-Waterman alignment scores each passage against its item. A passage that shares ``SHARED``
consecutive characters is a verbatim copy; one whose score is ``EDITED`` of the item's own or more is an
edited one, which seeds as short as these find where a word in three or four is replaced; the others share
little more than a seed.

The test items are the stated query set: their windows are held by every task, in blocks of at most
``BLOCK`` windows, one scan of the corpus for each block.

Defined results: null and empty texts and items shorter than a seed give no rows; copies of a document
are reported under each doc_id; an item repeated under several ids is reported under each; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestream.llm.common import code_points, squash, window_hashes
from lodestream.session import cut

SEED = 14
SHARED = 50
BLOCK = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -2
PAD = 40
EDITED = 0.4


def _item_windows(seed: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["text"]):
                hashes = window_hashes(code_points(squash(text or "")), seed)
                yield pd.DataFrame({"item_id": item, "item_pos": np.arange(len(hashes)), "h": hashes.view(np.int64)})

    return rows


def item_windows(items: DataFrame, seed: int = SEED) -> DataFrame:
    """``item_id, item_pos, h`` of every window of the items."""
    return items.select("item_id", "text").mapInPandas(_item_windows(seed), "item_id long, item_pos long, h long")


def _scan(wanted, seed: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = wanted.value
        for pdf in batches:
            docs, places, hashes = [], [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                h = window_hashes(code_points(squash(text or "")), seed).view(np.int64)
                if len(h) and len(known):
                    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                    if len(at):
                        docs.append(np.full(len(at), doc))
                        places.append(at)
                        hashes.append(h[at])
            if docs:
                yield pd.DataFrame({"doc_id": np.concatenate(docs), "doc_pos": np.concatenate(places), "h": np.concatenate(hashes)})

    return rows


def corpus_hits(documents: DataFrame, windows: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``doc_id, doc_pos, h``: where windows of the items occur in the corpus."""
    spark = documents.sparkSession
    blocks = -(-max(1, windows.select("h").distinct().count()) // block)
    hits = None
    for b in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).select("h").distinct()
        wanted = spark.sparkContext.broadcast(np.sort(part.toPandas()["h"].to_numpy(np.int64)))
        own = documents.select("doc_id", "text").mapInPandas(_scan(wanted, seed), "doc_id long, doc_pos long, h long")
        hits = own if hits is None else hits.unionByName(own)
    return hits


def seeds(windows: DataFrame, hits: DataFrame, seed: int = SEED, shared: int = SHARED) -> DataFrame:
    """Of each run of ``shared - seed + 1`` windows of an item the one found least in the corpus."""
    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # a window that an edit took out of the corpus does not hide the others of its run
    weighed = windows.join(counts, "h", "left").withColumn("rank", F.when(F.col("n").isNotNull(), F.struct("n", "h", "item_pos")))
    run = W.partitionBy("item_id").orderBy("item_pos").rowsBetween(0, shared - seed)
    rarest = weighed.withColumn("best", F.min("rank").over(run))
    return rarest.filter("best IS NOT NULL").select("item_id", F.col("best.h").alias("h"), F.col("best.item_pos").alias("item_pos")).distinct()


def _align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of the rows of ``a`` against the rows of ``b`` (0 pads), linear gaps."""
    n, m = b.shape
    slope = GAP * np.arange(m + 1, dtype=np.int32)
    last, best = np.zeros((n, m + 1), np.int32), np.zeros(n, np.int32)
    for i in range(a.shape[1]):
        own = a[:, i : i + 1]
        row = np.zeros_like(last)
        row[:, 1:] = np.maximum(last[:, :-1] + np.where((own == b) & (own > 0), MATCH, MISMATCH), last[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - slope, axis=1) + slope
        best = np.maximum(best, row.max(axis=1))
        last = row
    return best


def _padded(parts: list[str]) -> np.ndarray:
    out = np.zeros((len(parts), max(map(len, parts))), np.uint32)
    for row, part in zip(out, parts):
        row[: len(part)] = code_points(part)
    return out


def _shares(item: str, doc: str, shared: int) -> bool:
    return any(item[i : i + shared] in doc for i in range(len(item) - shared + 1))


def _judged(shared: int, pad: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                docs, items = [squash(t) for t in part["text"]], [squash(t) for t in part["item_text"]]
                first = np.maximum(part["low"].to_numpy() - pad, 0)
                passages = [d[f : f + h - f + len(i) + pad] for d, i, f, h in zip(docs, items, first, part["high"])]
                score = _align(_padded(items), _padded(passages))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"],
                    "item_id": part["item_id"],
                    "sw_score": score,
                    "sw_share": score / (MATCH * np.array([len(i) for i in items])),
                    "verbatim": [_shares(i, d, shared) for i, d in zip(items, docs)],
                })

    return rows


def leaks(documents: DataFrame, items: DataFrame, seed: int = SEED, shared: int = SHARED, pad: int = PAD) -> DataFrame:
    """``doc_id, item_id, sw_score, sw_share, verbatim, kind`` of every seeded pair.

    ``sw_share`` is the score over that of the whole item; ``verbatim`` says whether ``shared``
    consecutive characters are the same; ``kind`` is verbatim, edited or slight. A pair seeded on several
    diagonals keeps its best score.
    """
    items = items.filter(F.col("text").isNotNull()).dropDuplicates(["item_id"])
    windows = cut(item_windows(items, seed))
    hits = cut(corpus_hits(documents, windows, seed))
    pairs = hits.join(seeds(windows, hits, seed, shared), "h").withColumn("offset", F.col("doc_pos") - F.col("item_pos"))
    places = pairs.groupBy("doc_id", "item_id", F.floor(F.col("offset") / (2 * pad)).alias("band")).agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    passages = (
        documents.select("doc_id", "text")
        .join(cut(places), "doc_id")
        .dropDuplicates(["doc_id", "item_id", "band"])
        .join(items.select("item_id", F.col("text").alias("item_text")), "item_id")
        .select("doc_id", "item_id", "low", "high", "text", "item_text")
    )
    judged = passages.mapInPandas(_judged(shared, pad), "doc_id long, item_id long, sw_score long, sw_share double, verbatim boolean")
    best = judged.groupBy("doc_id", "item_id").agg(F.max("sw_score").alias("sw_score"), F.max("sw_share").alias("sw_share"), F.max("verbatim").alias("verbatim"))
    return best.withColumn("kind", F.when(F.col("verbatim"), "verbatim").when(F.col("sw_share") >= EDITED, "edited").otherwise("slight"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of the pairs that share ``SHARED`` consecutive characters."""
    return leaks(documents, items).filter("verbatim").select("doc_id", "item_id")
