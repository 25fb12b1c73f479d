"""The queries of the core operators by name, with the SQL that checks them.

Where a query needs a query set, it is every row whose id is divisible by 100, against all rows.
``documents`` plays the chunk store (``doc_id`` as id and order), ``embeddings`` its vectors; joining the
two by id is a synthetic link, and models are stand-ins (word overlap, a rule for verdicts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.ids import cache_key, point_id
from lodestream.functions.text import mask_secrets, sentences
from lodestream.operators import chunking, filtering, lake, retrieval, transcripts
from lodestream.session import cut
from lodestream.streaming.ingest import event_counts

PLUGINS = ["x_twscrape", "youtube_shorts", "youtube_long"]
NOW = "2025-04-10 00:00:00"
TTL = 24 * 21
META = "duration_s INT, view_count BIGINT, like_count BIGINT, upload_date STRING, video_id STRING, tweet_id STRING, start_s INT, end_s INT"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("tenant_id", F.col("doc_id").alias("ord"), "text")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, tenant_id, text, source, vector``: documents with a vector; the label is the tenant."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("tenant_id"))
    return _t(spark, d, "documents").select("doc_id", "text", "source").join(v, "doc_id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The item's fields and the metadata that filters need; copies of an envelope are still there, as dropping them here would shuffle all texts."""
    e = _t(spark, d, "raw_envelopes")
    meta = F.from_json("item.metadata", META)
    return e.select("harvest_id", "tenant_id", "source_name", "plugin_type", "harvested_at", F.col("item.title").alias("title"), F.col("item.content").alias("content"), F.col("item.source_url").alias("source_url"), F.col("item.locale").alias("locale"), meta.alias("m")).select("*", "m.start_s", "m.end_s")


def _arms(spark: SparkSession, d: str, top_k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Linked documents, the queries, and both arms over-fetched to twice ``top_k``."""
    docs = cut(_linked(spark, d))
    q = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "tenant_id", F.coalesce("text", F.lit("")).alias("query"), "vector")
    dense = cut(retrieval.dense_search(q, docs.select("tenant_id", F.col("doc_id").alias("id"), "vector"), 2 * top_k).withColumnRenamed("id", "doc_id"))
    sparse = retrieval.bm25_search(q, docs.select("tenant_id", F.col("doc_id").alias("ord"), "text"), 2 * top_k).withColumnRenamed("ord", "doc_id")
    return docs, q, dense, sparse


def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_stats(_docs(spark, d)).select("tenant_id", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_term_df(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.document_frequency(_docs(spark, d))


def bm25_tf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_counts(_docs(spark, d)).withColumnRenamed("ord", "doc_id")


def bm25_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    q = docs.filter("ord % 100 = 0").select(F.col("ord").alias("query_id"), "tenant_id", F.coalesce("text", F.lit("")).alias("query"))
    return retrieval.bm25_search(q, docs, 10).select("query_id", F.col("ord").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def dense_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("tenant_id"), F.col("embedding").alias("vector"))
    q = v.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return retrieval.dense_search(q, v, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    _, _, dense, sparse = _arms(spark, d, 5)
    lists = dense.select("query_id", F.lit(0).alias("list_id"), "rank", "doc_id").unionByName(sparse.select("query_id", F.lit(1).alias("list_id"), "rank", "doc_id"))
    return retrieval.rrf(lists).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    docs, _, dense, sparse = _arms(spark, d, 5)
    hits = retrieval.hybrid_retrieve(dense, sparse, docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source")), 5)
    return hits.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", "source")


def hybrid_rank_compare(spark: SparkSession, d: str) -> DataFrame:
    _, _, dense, sparse = _arms(spark, d, 5)
    both = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank")).join(sparse.select("query_id", "doc_id", F.col("rank").alias("bm25_rank")), ["query_id", "doc_id"], "full")
    return both.select("query_id", "doc_id", F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"))


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, q, dense, _ = _arms(spark, d, 10)
    hits = dense.join(docs.select("doc_id", "text"), "doc_id").join(q.select("query_id", "query"), "query_id")
    return retrieval.rerank(hits, F.round(retrieval.overlap_score(F.col("query"), F.col("text")), 9), 5).select("query_id", "doc_id", "score", "rank")


def crag_verdicts(spark: SparkSession, d: str) -> DataFrame:
    docs, q, dense, _ = _arms(spark, d, 10)
    hits = dense.join(docs.select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "text", "rank")
    graded = retrieval.overlap_score(F.col("query"), F.col("text")) >= 0.3
    out = retrieval.corrective(hits.filter("rank > 1 and rank <= 5"), hits.filter("rank > 1"), q.select("query_id", "query"), graded, 3)
    return out.select("query_id", "verdict", "attempts", F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"))


def filter_l1(spark: SparkSession, d: str) -> DataFrame:
    """Which items pass the first layer."""
    return _items(spark, d).select("harvest_id", filtering.passes_rules().alias("pass_l1")).distinct()


def filter_layers(spark: SparkSession, d: str) -> DataFrame:
    return filtering.layers(_items(spark, d)).select("harvest_id", "plugin_type", "pass_l1", "pass_l2", "clean_content", "judge_text").distinct()


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """``harvest_id, plugin_type, pass_l1, pass_l2, judge_text, key, verdict, cached`` with a stand-in for the cache: verdicts of two keys of three."""
    passed = cut(filtering.layers(_items(spark, d)).select("harvest_id", "plugin_type", "pass_l1", "pass_l2", "judge_text").distinct())
    keys = passed.filter("pass_l2").select(cache_key("stand-in", "1", F.col("judge_text")).alias("key")).distinct()
    cache = keys.filter(F.conv(F.substring("key", 40, 1), 16, 10).cast("int") % 3 > 0).select("key", F.lit(True).alias("verdict"), F.lit(NOW).cast("timestamp").alias("written"))
    return filtering.cached_verdicts(passed, cache, "stand-in", "1").withColumn("cached", F.col("verdict").isNotNull())


def filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    return filtering.funnel(_judged(spark, d))


def judge_cache_split(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).filter("pass_l2").groupBy("plugin_type").agg(F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("harvest_id", "plugin_type", F.coalesce("title", F.lit("")).alias("judge_text")).distinct()


def judge_batches(spark: SparkSession, d: str) -> DataFrame:
    return filtering.judge_batches(_titles(spark, d), "harvest_id").select("harvest_id", "batch_no", "pos")


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    return filtering.judge_prompts(filtering.judge_batches(_titles(spark, d), "harvest_id"))


def judge_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of a stand-in judge that answers one verdict too few on some batches, so that they are split and asked again."""

    def ask(prompts: DataFrame) -> DataFrame:
        n = F.regexp_count("prompt", F.lit(r"(?:^|\n\n)\d+\. "))
        said = F.array_repeat(F.lit("TRUE"), F.when((n > 4) & (F.col("batch_no") % 3 == 0), n - 1).otherwise(n).cast("int"))
        return prompts.select("plugin_type", "batch_no", F.array_join(said, ",").alias("answer"))

    ids = _items(spark, d).select("harvest_id", "plugin_type").distinct().withColumn("judge_text", F.lit("x"))
    return filtering.judge_rounds(filtering.judge_batches(ids, "harvest_id"), ask).select("harvest_id", "plugin_type", "verdict")


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", cache_key("stand-in", "1", F.col("text")).alias("key"))


def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_no", "chunk")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))


def ingest_payload(spark: SparkSession, d: str) -> DataFrame:
    return lake.payloads(_items(spark, d).select("content", "tenant_id", "source_url", "locale"), "tenant_demo").distinct()


def uuid5_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chunks").select("doc_id", point_id(F.col("text"), F.col("tenant_id")).alias("point_id")).distinct()


def upsert_dedupe(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "chunks")
    points = c.select(F.sha1(F.concat(F.coalesce("text", F.lit("")), F.coalesce("tenant_id", F.lit("")))).alias("id"), "doc_id")
    return lake.last_wins(points, ["doc_id"])


def segment_transcript(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.segment(_t(spark, d, "transcript_entries")).select("video_id", F.col("segment_index").cast("long"), F.col("total_segments").cast("long"), "start_s", "end_s", "text")


def json3_parse(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as subtitle documents and parsed again."""
    e = _t(spark, d, "transcript_entries").select("video_id", "pos", "text", F.round(F.col("start") * 1000).cast("long").alias("s"), F.round(F.col("duration") * 1000).cast("long").alias("l")).distinct()
    event = F.struct(F.col("s").alias("tStartMs"), F.col("l").alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))
    docs = e.groupBy("video_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s", "l", F.coalesce("text", F.lit("")).alias("t"), event.alias("e")))), lambda x: x["e"]).alias("events"))).alias("body"))
    return transcripts.parse_json3(docs).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("start"), 3).alias("start_sum"), F.round(F.sum("duration"), 3).alias("duration_sum"))


def phase_gate_limit(spark: SparkSession, d: str) -> DataFrame:
    v = _items(spark, d).filter("plugin_type like 'youtube%'").select("source_name", "harvest_id", "m").distinct()
    gate = transcripts.passes_gates(F.col("m.duration_s"), F.col("m.view_count"), 30, 3000, 100)
    picked = transcripts.select_videos(v, gate, "harvest_id", 10)
    return picked.select("source_name", "harvest_id", "place", "skipped")


def freshness(spark: SparkSession, d: str) -> DataFrame:
    v = _items(spark, d).filter("plugin_type like 'youtube%'").select("source_name", "harvest_id", "m").distinct()
    return v.groupBy("source_name").agg(F.count_if(transcripts.fresh(F.col("m.upload_date"), "20250310")).alias("fresh"), F.count(F.lit(1)).alias("total"))


def harvest_report(spark: SparkSession, d: str) -> DataFrame:
    return lake.harvest_report(_t(spark, d, "source_configs"), _t(spark, d, "raw_envelopes"), PLUGINS)


def plugin_config_counts(spark: SparkSession, d: str) -> DataFrame:
    return lake.plugin_counts(_t(spark, d, "source_configs"), PLUGINS)


def retention_ttl(spark: SparkSession, d: str) -> DataFrame:
    return lake.retention_report(_t(spark, d, "raw_envelopes"), F.lit(NOW).cast("timestamp"), TTL)


def envelope_flatten(spark: SparkSession, d: str) -> DataFrame:
    return lake.flatten(_t(spark, d, "raw_envelopes")).select("harvest_id", "tenant_id", "source_name", "source_url", "title", "locale", F.size("media_urls").alias("n_media")).distinct()


def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("harvest_id", "plugin_type", "m").distinct().groupBy("plugin_type").agg(F.count("m.view_count").alias("with_views"), F.sum(F.coalesce("m.view_count", F.lit(0))).alias("views"), F.coalesce(F.max("m.duration_s"), F.lit(0)).alias("longest"))


def secret_mask(spark: SparkSession, d: str) -> DataFrame:
    masked = _t(spark, d, "source_configs").select("name", F.explode(mask_secrets(F.col("options"))).alias("option", "value"))
    return masked.select("name", "option", "value")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return event_counts(_t(spark, d, "events"))


def tenant_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Items and different sources by tenant and plugin, with totals."""
    e = _t(spark, d, "raw_envelopes").select("tenant_id", "plugin_type", "harvest_id", "source_name").distinct()
    return e.rollup("tenant_id", "plugin_type").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("source_name").alias("sources"), F.grouping_id().cast("int").alias("level"))


FLAGSHIP = hybrid_retrieve
_NAMES = """
bm25_corpus_stats bm25_term_df bm25_tf bm25_topk_batch dense_topk_batch rrf_two_lists hybrid_retrieve hybrid_rank_compare rerank_topk
crag_verdicts filter_l1 filter_layers filter_funnel judge_cache_split judge_batches judge_prompts judge_rounds cache_keys chunk_docs sentence_split
ingest_payload uuid5_ids upsert_dedupe segment_transcript json3_parse phase_gate_limit freshness harvest_report plugin_config_counts
retention_ttl envelope_flatten metadata_json secret_mask event_windows tenant_funnel
""".split()


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES}


def oracle_sql() -> dict[str, str]:
    from lodestream.plans.oracle import SQL

    return dict(SQL)
