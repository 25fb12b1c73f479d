"""The queries of the numbered problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import encoding, history, languages, leakage, lookalikes, neardup, pii, sentences, site_lines, splitting
from lodestream.llm.common import record_rows, table


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_envelopes")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return record_rows(table(spark, d, "raw_envelopes"), table(spark, d, "chunks"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.boilerplate(_envelopes(spark, d)).select("harvest_id", "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.strip_lines(_envelopes(spark, d)).select("harvest_id", "clean_content").distinct()


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.block_report(_envelopes(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(_records(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_records(_records(spark, d)).select("rec_kind", "rec_id", "piece_no", "n_pieces", "start_pos", "end_pos", "piece")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.found(_records(spark, d))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.unify_records(_records(spark, d)).select("rec_kind", "rec_id", "unified")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(_envelopes(spark, d))


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.documents(_envelopes(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(_records(spark, d))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_records(spark, d)).select("rec_kind", "rec_id", "redacted")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_documents(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode_documents(encoding.encode_documents(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_alignments(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(_envelopes(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_envelopes(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.found(_envelopes(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(table(spark, d, "documents"))


def p10_unmarked(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"), unmarked=True).select("doc_id", "unit_no", "start_pos", "end_pos")


def p10_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_P1 = r"""
WITH e AS (SELECT DISTINCT source_name, harvest_id, item.content AS content FROM raw_envelopes),
l AS (SELECT coalesce(source_name, chr(1)) AS s, harvest_id, unnest(string_split(content, chr(10))) AS line,
             generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM e),
n AS (SELECT s, harvest_id, CAST(line_no AS INTEGER) AS line_no,
             regexp_replace(trim(regexp_replace(lower(line), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), '\p{Nd}+', '0', 'g') AS k FROM l),
t AS (SELECT coalesce(source_name, chr(1)) AS s, count(DISTINCT harvest_id) AS total FROM e GROUP BY 1),
h AS (SELECT s, k FROM n JOIN t USING (s) WHERE k <> '' GROUP BY s, k, total
      HAVING count(DISTINCT harvest_id) >= 5 AND count(DISTINCT harvest_id) >= 0.05 * total)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p2_found": """SELECT 'item' AS rec_kind, harvest_id AS rec_id FROM raw_envelopes WHERE length(item.content) > 2000
        UNION SELECT 'chunk', doc_id FROM chunks WHERE length(text) > 2000""",
        "p1_found": _P1 + "SELECT DISTINCT harvest_id, line_no FROM n JOIN h USING (s, k)",
        "p1_clean": _P1
        + """, r AS (SELECT DISTINCT n.harvest_id, n.line_no FROM n JOIN h USING (s, k)),
        k AS (SELECT l.harvest_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS kept
              FROM l LEFT JOIN r USING (harvest_id, line_no) WHERE r.line_no IS NULL GROUP BY 1)
        SELECT DISTINCT e.harvest_id, CASE WHEN e.content IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS clean_content
        FROM e LEFT JOIN k USING (harvest_id)""",
    }
