"""Problem 1: lines repeated across the documents of one source.

Nodes are the distinct normalised lines of a source weighted by the number of harvest_ids that hold
them; edges join lines that follow each other (blank lines between them are passed over). Nodes and
edges under the support thresholds are dropped, the connected components that remain are the
boilerplate blocks, and each occurrence of a line of a block is deleted.

Only hashes of lines and ids are shuffled, never the texts: a key of a line is the 64-bit hash of its
normal form, counted within its source. The lines that stay under the thresholds are at most
``1 / share`` times the mean number of lines a document, for each source, so blocks are built per
source within that bound.

Defined results: a null source is a source of its own; null or empty contents have no lines but their
harvest_id counts in the total; copies of an envelope count once; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestream.session import cut, small_side

MIN_DOCS = 5
MIN_SHARE = 0.05
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def line_key(line):
    """The normal form under which two lines are the same; blank lines give an empty string."""
    text = F.regexp_replace(F.lower(line), SPACE, " ")
    return F.regexp_replace(F.trim(text), r"\p{Nd}+", "0")


def _lines(envelopes: DataFrame) -> DataFrame:
    """``sid, hid, harvest_id, line_no, rank, key`` of each non-blank line; ``rank`` counts these only."""
    keyed = F.transform(F.split("item.content", "\n"), lambda x, i: F.struct(i.alias("line_no"), line_key(x).alias("norm")))
    return envelopes.select(
        F.xxhash64(F.coalesce(F.col("source_name"), F.lit("\0"))).alias("sid"),
        F.xxhash64("harvest_id").alias("hid"),
        "harvest_id",
        F.posexplode(F.filter(keyed, lambda x: x["norm"] != "")).alias("rank", "line"),
    ).select("sid", "hid", "harvest_id", F.col("line.line_no").alias("line_no"), "rank", F.xxhash64("line.norm").alias("key"))


def _totals(envelopes: DataFrame) -> DataFrame:
    return (
        envelopes.select(F.xxhash64(F.coalesce(F.col("source_name"), F.lit("\0"))).alias("sid"), F.xxhash64("harvest_id").alias("hid"))
        .distinct()
        .groupBy("sid")
        .agg(F.count(F.lit(1)).alias("total"))
    )


def frequent_lines(envelopes: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """High-support nodes ``sid, key, support, total``."""
    support = _lines(envelopes).select("sid", "key", "hid").distinct().groupBy("sid", "key").agg(F.count(F.lit(1)).alias("support"))
    return (
        support.filter(F.col("support") >= min_docs)
        .join(_totals(envelopes), "sid")
        .filter(F.col("support") >= F.lit(min_share) * F.col("total"))
        .select("sid", "key", "support", "total")
    )


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one source's kept lines; ``other`` is null for a line without edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, linked in zip(pdf["key"], pdf["other"], pdf["linked"]):
        a, b = find(a), find(b if linked else a)
        if a != b:
            root[max(a, b)] = min(a, b)
    keys = sorted(root)
    return pd.DataFrame({"sid": pdf["sid"].iloc[0], "key": keys, "block": [find(k) for k in keys]})


def occurrences(envelopes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lines of the texts that are kept nodes."""
    return _lines(envelopes).join(nodes, ["sid", "key"])


def blocks(found: DataFrame, nodes: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``sid, key, block``: the boilerplate block of each kept line."""
    follow = W.partitionBy("hid", "harvest_id").orderBy("line_no")
    edges = (
        found.dropDuplicates(["harvest_id", "line_no"])
        .withColumn("other", F.lead("key").over(follow))
        .withColumn("step", F.lead("rank").over(follow) - F.col("rank"))
        .filter((F.col("step") == 1) & (F.col("other") != F.col("key")))
        .groupBy("sid", "key", "other")
        .agg(F.count_distinct("hid").alias("weight"), F.first("total").alias("total"))
        .filter((F.col("weight") >= min_docs) & (F.col("weight") >= F.lit(min_share) * F.col("total")))
        .select("sid", "key", "other", F.lit(True).alias("linked"))
    )
    graph = edges.unionByName(nodes.select("sid", "key", F.col("key").alias("other"), F.lit(False).alias("linked")))
    return graph.groupBy("sid").applyInPandas(_components, "sid long, key long, block long")


def boilerplate(envelopes: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``harvest_id, line_no, block``: each line to delete and the block it belongs to, once per envelope."""
    nodes = small_side(cut(frequent_lines(envelopes, min_docs, min_share)))
    found = occurrences(envelopes, nodes)
    members = cut(blocks(found, nodes, min_docs, min_share))
    return found.join(small_side(members), ["sid", "key"]).select("harvest_id", "line_no", "block").distinct()


def block_report(envelopes: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``source_name, block, n_lines, n_docs``: the boilerplate blocks of each source, with their different lines and the envelopes that hold one."""
    nodes = small_side(cut(frequent_lines(envelopes, min_docs, min_share)))
    found = occurrences(envelopes, nodes)
    members = cut(blocks(found, nodes, min_docs, min_share))
    names = envelopes.select("source_name", F.xxhash64(F.coalesce(F.col("source_name"), F.lit("\0"))).alias("sid")).distinct()
    held = found.select("sid", "key", "hid").distinct().join(small_side(members), ["sid", "key"]).select("sid", "block", "hid").distinct()
    docs = held.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("n_docs"))
    lines = members.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("n_lines"))
    return lines.join(docs, ["sid", "block"]).join(small_side(cut(names)), "sid").select("source_name", "block", "n_lines", "n_docs")


def strip_lines(envelopes: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """Each envelope with ``clean_content``: its content without the lines of blocks, all others unchanged."""
    gone = boilerplate(envelopes, min_docs, min_share).groupBy("harvest_id").agg(F.collect_set("line_no").alias("_gone"))
    lines = F.split("item.content", "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("_gone"), s["i"]))
    return (
        envelopes.join(gone, "harvest_id", "left")
        .withColumn("clean_content", F.when(F.col("_gone").isNull(), F.col("item.content")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n")))
        .drop("_gone")
    )
