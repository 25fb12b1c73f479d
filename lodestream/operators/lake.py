"""The raw lake and the chunk store: landing, reading, retention, ingestion and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestream.functions.ids import point_id
from lodestream.functions.text import or_else
from lodestream.operators.chunking import MAX_WORDS, OVERLAP_WORDS, chunk
from lodestream.session import cut, delete, exists, small_side

TTL_HOURS = 72
#: The folder name of a null partition value.
F_NULL = "__HIVE_DEFAULT_PARTITION__"


def land(envelopes: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append envelopes to the lake, partitioned by tenant and plugin (no file a row)."""
    envelopes.write.partitionBy("tenant_id", "plugin_type").mode("append").format(fmt).save(path)


def flatten(envelopes: DataFrame) -> DataFrame:
    """The item's fields beside the envelope's names."""
    return envelopes.select("item.*", "tenant_id", "source_name", "harvest_id")


def expired(harvested_at: Column, now: Column, ttl_hours: float = TTL_HOURS) -> Column:
    """Whether a row is past its time to live; 0 or less keeps all, a null time is kept."""
    if ttl_hours <= 0:
        return F.lit(False)
    return F.coalesce(harvested_at < now - F.make_dt_interval(hours=F.lit(int(ttl_hours))), F.lit(False))


def retention_report(envelopes: DataFrame, now: Column, ttl_hours: float = TTL_HOURS, by: str = "plugin_type") -> DataFrame:
    """``<by>, deleted, kept``."""
    gone = expired(F.col("harvested_at"), now, ttl_hours)
    return envelopes.groupBy(by).agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def retain(envelopes: DataFrame, now: Column, ttl_hours: float = TTL_HOURS) -> DataFrame:
    return envelopes.filter(~expired(F.col("harvested_at"), now, ttl_hours))


def delete_expired(spark: SparkSession, path: str, now: Column, ttl_hours: float = TTL_HOURS) -> int:
    """Delete what is past its time to live from a lake written by ``land`` (parquet); returns the rows deleted.

    Only the partitions that hold such rows are written anew; a partition in which all are expired goes.
    """
    lake = spark.read.parquet(path)
    old = lake.filter(expired(F.col("harvested_at"), now, ttl_hours))
    touched = cut(old.groupBy("tenant_id", "plugin_type").agg(F.count(F.lit(1)).alias("n")))
    deleted = touched.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if deleted:
        pairs = touched.select("tenant_id", "plugin_type")
        same = lambda a, b: F.col(f"{a}.tenant_id").eqNullSafe(F.col(f"{b}.tenant_id")) & F.col(f"{a}.plugin_type").eqNullSafe(F.col(f"{b}.plugin_type"))
        kept = cut(retain(lake, now, ttl_hours).alias("l").join(small_side(pairs).alias("t"), same("l", "t"), "left_semi"))
        kept.write.partitionBy("tenant_id", "plugin_type").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        gone = pairs.alias("t").join(kept.select("tenant_id", "plugin_type").distinct().alias("l"), same("t", "l"), "left_anti")
        for row in gone.toLocalIterator():
            names = [F_NULL if row[c] is None else row[c] for c in ("tenant_id", "plugin_type")]
            delete(spark, f"{path}/tenant_id={names[0]}/plugin_type={names[1]}")
    return deleted


def payloads(items: DataFrame, tenant: str, max_words: int = MAX_WORDS, overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """``id, chunk_no, text, tenant_id, source_url, locale`` of each chunk of approved items.

    The clean content is chunked, else the content; an item without tenant falls back to ``tenant``.
    """
    cols = items.columns
    pick = lambda *names: or_else(*(F.col(n) for n in names if n in cols))
    rows = items.select(pick("clean_content", "content").alias("body"), or_else(F.col("tenant_id"), F.lit(tenant)).alias("tenant_id"), pick("source_url").alias("source_url"), pick("locale").alias("locale"))
    parts = chunk(rows, "body", max_words, overlap_words)
    return parts.select(point_id(F.col("chunk"), F.col("tenant_id")).alias("id"), "chunk_no", F.col("chunk").alias("text"), "tenant_id", "source_url", "locale")


def last_wins(points: DataFrame, order: list) -> DataFrame:
    """One row for each id: the last in ``order``."""
    place = F.row_number().over(W.partitionBy("id").orderBy(*[F.desc(c) for c in order]))
    return points.withColumn("_p", place).filter("_p = 1").drop("_p")


def upsert(spark: SparkSession, points: DataFrame, path: str, order: list) -> int:
    """Write points into the collection at ``path``; the same id is overwritten. Returns the points submitted.

    A run appends only points that are new or differ from what the collection shows for their id, so a run
    that is repeated writes nothing. Each run has a number of its own, and the latest of an id counts.
    """
    points = cut(points)
    n = points.count()
    if n:
        new = last_wins(points, order)
        run = 0
        if exists(spark, path):
            there = read_collection(spark, path)
            run = 1 + (spark.read.parquet(path).agg(F.max("_run")).first()[0] or 0)
            same = F.lit(True)
            for c in new.columns:
                same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
            new = new.alias("n").join(there.alias("o"), same, "left_anti")
        new.withColumn("_run", F.lit(run)).write.partitionBy("tenant_id").mode("append").parquet(path)
    return n


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each id."""
    return last_wins(spark.read.parquet(path), ["_run"]).drop("_run")


def compact(spark: SparkSession, path: str) -> None:
    """Write the collection anew without what later runs replaced; readers of the old files must have ended."""
    whole = cut(last_wins(spark.read.parquet(path), ["_run"]))
    whole.write.partitionBy("tenant_id").mode("overwrite").parquet(path)


def check_dimension(vectors: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    """The rows with vectors of a collection's ``size``; a vector of another size fails the job, a null one is left out."""
    wrong = F.raise_error(F.format_string("a vector of %d numbers for a collection of %d", F.size(vector), F.lit(size)))
    return vectors.filter(F.col(vector).isNotNull()).withColumn(vector, F.when(F.size(vector) == size, F.col(vector)).otherwise(wrong))


def source_status(sources: DataFrame, plugins: list[str]) -> Column:
    """What would come of each source: the gates in their order."""
    return (
        F.when(~F.coalesce("enabled", F.lit(True)), "skipped")
        .when(F.coalesce("tenant_id", F.lit("")) == "", "discarded")
        .when(~F.coalesce(F.col("type").isin(plugins), F.lit(False)), "unknown_plugin")
        .otherwise("ok")
    )


def harvest_report(sources: DataFrame, envelopes: DataFrame, plugins: list[str]) -> DataFrame:
    """``source_name, status, items, failed``: each configured source, its status and the different items landed of it."""
    landed = envelopes.groupBy(F.col("source_name").alias("name")).agg(F.count_distinct("harvest_id").alias("items"))
    status = sources.select("name", source_status(sources, plugins).alias("status"))
    return status.join(landed, "name", "left").select(F.col("name").alias("source_name"), "status", F.coalesce("items", F.lit(0)).alias("items"), (F.col("status") != "ok").alias("failed"))


def plugin_counts(sources: DataFrame, plugins: list[str]) -> DataFrame:
    """``type, configured, known``: configured sources of each plugin, unknown types flagged."""
    return sources.groupBy(F.coalesce("type", F.lit("")).alias("type")).agg(F.count(F.lit(1)).alias("configured")).withColumn("known", F.col("type").isin(plugins))
