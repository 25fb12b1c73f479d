"""What the numbered operators share: reading the tables and the hashing of n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_rows(envelopes: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, text`` of the envelopes (``item``)."""
    return envelopes.select(F.lit("item").alias("rec_kind"), F.col("harvest_id").alias("rec_id"), F.col("item.content").alias("text"))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, text`` of the chunks (``chunk``)."""
    return chunks.select(F.lit("chunk").alias("rec_kind"), F.col("doc_id").alias("rec_id"), F.col("text"))


def record_rows(envelopes: DataFrame, chunks: DataFrame) -> DataFrame:
    return item_rows(envelopes).unionByName(chunk_rows(chunks))


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Even out the input over ``factor`` tasks a core when the scan gave fewer, as one small file does."""
    spark = df.sparkSession
    want = factor * max(1, spark.sparkContext.defaultParallelism)
    return df.repartition(want) if df.rdd.getNumPartitions() * 2 < want else df


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every window of ``k`` code points, in order."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = points.astype(np.uint64)
    # doubling: windows of 1, 2, 4, ... joined as the bits of k ask
    h, have, whole, done = p + np.uint64(1), 1, None, 0
    left, power = k, int(_MUL)
    while left:
        if left & 1:
            part = h[done : done + n]
            whole = part.copy() if whole is None else whole * np.uint64(power) + part
            done += have
        left >>= 1
        if left:
            h = h[:-have] * np.uint64(power) + h[have:]
            have *= 2
            power = (power * power + 2) & 0xFFFFFFFFFFFFFFFF
    whole ^= whole >> _S29
    whole *= _MIX
    whole ^= whole >> _S32
    return whole


def squash(text: str) -> str:
    """Lower-case and keep letters and digits only."""
    return "".join(filter(str.isalnum, text.lower()))
