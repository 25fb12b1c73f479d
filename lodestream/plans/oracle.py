"""DuckDB SQL for the core queries."""

from __future__ import annotations

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _tok(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '{_WS}+'), lambda x: x <> '')"


def _words(x: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({x}, ''), '{_WS}+'), lambda x: x <> ''))"


def _meta(x: str) -> str:
    return f"json_extract_string(metadata, '$.{x}')"


_ITEMS = """i AS (SELECT DISTINCT harvest_id, tenant_id, source_name, plugin_type, harvested_at, item.title AS title,
  item.content AS content, item.metadata AS metadata FROM raw_envelopes)"""


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _bm25(docs: str, queries: str, k: int) -> str:
    """CTEs ending in ``b(query_id, doc_id, score, rank)`` from ``d(tenant_id, doc_id, text)`` and ``q(query_id, tenant_id, query)``."""
    return f"""
d AS ({docs}), q AS ({queries}),
w AS (SELECT tenant_id, doc_id, {_tok('text')} AS ws FROM d),
st AS (SELECT tenant_id, count(*) AS n, avg(len(ws)) AS a FROM w GROUP BY 1),
tf AS (SELECT tenant_id, doc_id, dl, term, count(*) AS tf FROM (SELECT tenant_id, doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) GROUP BY ALL),
df AS (SELECT tenant_id, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query_id, tenant_id, term, count(*) AS qtf FROM (SELECT query_id, tenant_id, unnest({_tok('query')}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score
       FROM qt JOIN df USING (tenant_id, term) JOIN st USING (tenant_id) JOIN tf USING (tenant_id, term) GROUP BY ALL),
al AS (SELECT q.query_id, d.doc_id, coalesce(sc.score, 0.0) AS score FROM q JOIN d USING (tenant_id) LEFT JOIN sc ON sc.query_id = q.query_id AND sc.doc_id = d.doc_id),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM al QUALIFY rank <= {k})"""


def _dense(vectors: str, k: int) -> str:
    """CTEs ending in ``v(query_id, doc_id, score, rank)`` from ``e(doc_id, tenant_id, vec)``."""
    return f"""
e AS ({vectors}),
n AS (SELECT doc_id, tenant_id, vec, sqrt(list_inner_product(vec, vec)) AS nn FROM e),
v AS (SELECT a.doc_id AS query_id, b.doc_id, round(list_inner_product(a.vec, b.vec) / (a.nn * b.nn), 9) AS score,
        CAST(row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_inner_product(a.vec, b.vec) / (a.nn * b.nn), 9) DESC, b.doc_id) AS INTEGER) AS rank
      FROM n a JOIN n b USING (tenant_id) WHERE a.doc_id % 100 = 0 QUALIFY rank <= {k})"""


_LINK = "l AS (SELECT doc_id, text, source, CAST(label AS VARCHAR) AS tenant_id, CAST(embedding AS DOUBLE[]) AS vec FROM documents JOIN embeddings ON doc_id = vec_id)"


def _arms(k: int) -> str:
    return (
        "WITH "
        + _LINK
        + ","
        + _bm25("SELECT tenant_id, doc_id, text FROM l", "SELECT doc_id AS query_id, tenant_id, coalesce(text, '') AS query FROM l WHERE doc_id % 100 = 0", k)
        + ","
        + _dense("SELECT doc_id, tenant_id, vec FROM l", k)
    )


_RRF = """, r AS (SELECT query_id, doc_id, 0 AS li, rank FROM v UNION ALL SELECT query_id, doc_id, 1, rank FROM b),
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(struct_pack(a := li, b := rank)) AS fi FROM r GROUP BY ALL),
o AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fi.a, fi.b, doc_id) AS INTEGER) AS rank FROM f)"""
_OVER = f"coalesce(CAST(len(list_intersect(list_distinct({_tok('query')}), list_distinct({_tok('text')}))) AS DOUBLE) / nullif(len(list_distinct({_tok('query')})), 0), 0.0)"
_CTA = (
    r"(?i)(?:^|[^\p{L}\p{N}_])(?:"
    + rf"join{_WS}+(?:our|my|the){_WS}+(?:discord|telegram|group|community|channel)|follow{_WS}+(?:for|us|me){_WS}+(?:more|back)|link{_WS}+in{_WS}+(?:bio|profile)"
    + rf"|retweet{_WS}+to{_WS}+win|drop{_WS}+(?:your|a){_WS}+(?:wallet|address))|^gm(?:!|{_WS})"
)


def _entries(text: str) -> str:
    return f"""e AS (SELECT DISTINCT video_id, pos, {text} AS text, CAST(round(coalesce(start, 0) * 1000) AS BIGINT) AS s,
  CAST(round(coalesce(duration, 0) * 1000) AS BIGINT) AS l FROM transcript_entries)"""


_SPLIT = rf"list_filter(string_split_regex(regexp_replace({_strip('text')}, '([.!?。！？]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"



def _chunks(rows: str) -> str:
    """CTEs ending in ``k(id, chunk_no, chunk)`` from ``rows`` (``id, text``): greedy packs of sentences, by running sums of words."""
    return f"""
t AS (SELECT id, {_strip("coalesce(text, '')")} AS t FROM ({rows})),
s AS (SELECT id, {_SPLIT.replace(_strip("text"), "t")} AS p FROM t WHERE {_words('t')} > 400),
w AS (SELECT id, p, list_transform(p, lambda y: {_words('y')}) AS w FROM s),
c AS (SELECT id, len(p) AS n, list_transform(range(0, len(p) + 1), lambda y: coalesce(list_sum(w[1:y]), 0)) AS c FROM w),
r AS (SELECT id, 0 AS no, 0 AS b, coalesce(list_filter(range(1, n), lambda i: c[i + 2] - c[1] > 400)[1], n) AS e FROM c
  UNION ALL SELECT id, no + 1, nb, coalesce(list_filter(range(e + 1, n), lambda i: c[i + 2] - c[nb + 1] > 400)[1], n)
  FROM (SELECT r.id, no, e, n, c, coalesce(list_filter(range(b, e), lambda i: c[e + 1] - c[i + 1] <= 60)[1], e - 1) AS nb FROM r JOIN c USING (id) WHERE e < n)),
k AS (SELECT id, 0 AS chunk_no, t AS chunk FROM t WHERE t <> '' AND {_words('t')} <= 400
  UNION ALL SELECT id, CAST(no AS INTEGER), array_to_string(p[b + 1:e], ' ') FROM r JOIN s USING (id))"""


def _uuid5(x: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x}))"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '5' || substr({h}, 14, 3), translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3), substr({h}, 21, 12))"


SQL = {
    "chunk_docs": "WITH RECURSIVE " + _chunks("SELECT doc_id AS id, text FROM documents") + " SELECT id AS doc_id, chunk_no, chunk FROM k",
    "ingest_payload": """WITH RECURSIVE o AS (SELECT DISTINCT harvest_id AS id, item.content AS text, coalesce(nullif(tenant_id, ''), 'tenant_demo') AS tenant_id,
      coalesce(item.source_url, '') AS source_url, coalesce(item.locale, '') AS locale FROM raw_envelopes),"""
    + _chunks("SELECT id, text FROM o")
    + f""" SELECT DISTINCT {_uuid5("chunk || tenant_id")} AS id, chunk_no, chunk AS text, tenant_id, source_url, locale FROM k JOIN o USING (id)""",
    "bm25_corpus_stats": f"SELECT tenant_id, count(*) AS n_docs, round(avg(len({_tok('text')})), 6) AS avgdl FROM documents GROUP BY 1",
    "bm25_term_df": f"SELECT tenant_id, term, count(*) AS df FROM (SELECT tenant_id, unnest(list_distinct({_tok('text')})) AS term FROM documents) GROUP BY ALL",
    "bm25_tf": f"SELECT tenant_id, doc_id, term, count(*) AS tf FROM (SELECT tenant_id, doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL",
    "bm25_topk_batch": "WITH "
    + _bm25("SELECT tenant_id, doc_id, text FROM documents", "SELECT doc_id AS query_id, tenant_id, coalesce(text, '') AS query FROM documents WHERE doc_id % 100 = 0", 10)
    + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM b",
    "dense_topk_batch": "WITH " + _dense("SELECT vec_id AS doc_id, label AS tenant_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings", 10) + " SELECT query_id, doc_id AS id, round(score, 6) AS score, rank FROM v",
    "rrf_two_lists": _arms(10) + _RRF + " SELECT query_id, doc_id, round(score, 9) AS score, rank FROM o",
    "hybrid_retrieve": _arms(10)
    + _RRF
    + " SELECT o.query_id, o.doc_id, round(o.score, 9) AS score, o.rank, coalesce(l.source, '') AS source FROM o JOIN v ON v.query_id = o.query_id AND v.doc_id = o.doc_id JOIN l ON l.doc_id = o.doc_id WHERE o.rank <= 5",
    "hybrid_rank_compare": _arms(10) + " SELECT query_id, doc_id, coalesce(v.rank, 0) AS dense_rank, coalesce(b.rank, 0) AS bm25_rank FROM v FULL JOIN b USING (query_id, doc_id)",
    "rerank_topk": _arms(20)
    + f""", h AS (SELECT v.query_id, v.doc_id, v.rank AS r, q.query, l.text FROM v JOIN q USING (query_id) JOIN l ON l.doc_id = v.doc_id),
    s AS (SELECT query_id, doc_id, r, round({_OVER}, 9) AS score FROM h)
    SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
    "crag_verdicts": _arms(20)
    + f""", h AS (SELECT q.query_id, v.doc_id, v.rank AS r, ({_OVER}) >= 0.3 AS yes FROM v JOIN q USING (query_id) JOIN l ON l.doc_id = v.doc_id WHERE v.rank > 1),
    a AS (SELECT query_id, count(doc_id) FILTER (r <= 5) AS n1, count(doc_id) FILTER (yes AND r <= 5) AS r1, count(doc_id) AS n2, count(doc_id) FILTER (yes) AS r2,
      list_slice(list(doc_id ORDER BY r) FILTER (yes AND r <= 5), 1, 3) AS c1, list_slice(list(doc_id ORDER BY r) FILTER (yes), 1, 3) AS c2 FROM q LEFT JOIN h USING (query_id) GROUP BY 1)
    SELECT query_id, CASE WHEN r1 > 0 THEN CASE WHEN r1 >= 0.5 * n1 THEN 'CORRECT' ELSE 'AMBIGUOUS' END WHEN r2 = 0 THEN 'INCORRECT' WHEN r2 >= 0.5 * n2 THEN 'CORRECT' ELSE 'AMBIGUOUS' END AS verdict,
      CAST(CASE WHEN r1 > 0 THEN 0 WHEN r2 > 0 THEN 1 ELSE 2 END AS INTEGER) AS attempts, coalesce(array_to_string(CASE WHEN r1 > 0 THEN c1 ELSE c2 END, ','), '') AS context FROM a""",
    "filter_l1": f"""WITH {_ITEMS}, s AS (SELECT *, {_strip("coalesce(content, '')")} AS t FROM i)
    SELECT harvest_id, CASE plugin_type WHEN 'x_twscrape' THEN NOT starts_with(t, '@') AND {_words('t')} >= 15
        AND len(regexp_extract_all(t, '#[\\p{{L}}\\p{{N}}_]+')) <= 3 AND len(regexp_extract_all(t, '@[\\p{{L}}\\p{{N}}_]+')) <= 2 AND NOT regexp_matches(t, '{_CTA}')
      WHEN 'youtube_shorts' THEN {_words("concat_ws(' ', title, content)")} >= 10 ELSE {_words('content')} >= 40 END AS pass_l1 FROM s""",
    "judge_batches": f"WITH {_ITEMS}, n AS (SELECT harvest_id, row_number() OVER (PARTITION BY plugin_type ORDER BY harvest_id) - 1 AS n FROM i) SELECT harvest_id, CAST(n // 8 AS INTEGER) AS batch_no, CAST(n % 8 AS INTEGER) AS pos FROM n",
    "judge_prompts": f"""WITH {_ITEMS}, n AS (SELECT plugin_type, coalesce(title, '') AS t, row_number() OVER (PARTITION BY plugin_type ORDER BY harvest_id) - 1 AS n FROM i)
    SELECT plugin_type, CAST(n // 8 AS INTEGER) AS batch_no, string_agg((n % 8 + 1) || '. ' || substring(t, 1, 500), chr(10) || chr(10) ORDER BY n) AS prompt FROM n GROUP BY 1, 2""",
    "judge_rounds": "SELECT DISTINCT harvest_id, plugin_type, TRUE AS verdict FROM raw_envelopes",
    "cache_keys": "SELECT doc_id, sha1('stand-in|1|' || coalesce(text, '')) AS key FROM documents",
    "sentence_split": f"""WITH s AS (SELECT doc_id, {_SPLIT} AS p FROM documents)
    SELECT doc_id, CAST(unnest(generate_series(0, len(p) - 1)) AS INTEGER) AS sentence_no, unnest(p) AS sentence FROM s WHERE len(p) > 0""",
    "uuid5_ids": """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(coalesce(text, '') || coalesce(tenant_id, ''))) AS h FROM chunks)
    SELECT DISTINCT doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)) AS point_id FROM h""",
    "upsert_dedupe": "SELECT sha1(coalesce(text, '') || coalesce(tenant_id, '')) AS id, max(doc_id) AS doc_id FROM chunks GROUP BY 1",
    "segment_transcript": f"""WITH {_entries(_strip("coalesce(text, '')"))},
    w AS (SELECT *, (s - min(s) OVER (PARTITION BY video_id)) // 120000 AS w FROM e),
    g AS (SELECT video_id, w, arg_min(s, struct_pack(s := s, pos := pos, l := l, t := text)) / 1000.0 AS start_s, arg_max(s + l, struct_pack(s := s, pos := pos, l := l, t := text)) / 1000.0 AS end_s,
      {_strip("string_agg(text, ' ' ORDER BY s, pos, l, text)")} AS text FROM w GROUP BY ALL),
    k AS (SELECT * FROM g WHERE text <> '')
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY w) - 1 AS segment_index, count(*) OVER (PARTITION BY video_id) AS total_segments, start_s, end_s, text FROM k""",
    "json3_parse": f"""WITH x AS (SELECT DISTINCT video_id, pos, text, CAST(round(start * 1000) AS BIGINT) AS s, CAST(round(duration * 1000) AS BIGINT) AS l FROM transcript_entries)
    SELECT video_id, count(*) AS n, round(sum(coalesce(s, 0) / 1000.0), 3) AS start_sum, round(sum(coalesce(l, 0) / 1000.0), 3) AS duration_sum FROM x WHERE {_strip("coalesce(text, '')")} <> '' GROUP BY 1""",
    "phase_gate_limit": f"""WITH {_ITEMS}, g AS (SELECT source_name, harvest_id, coalesce(CAST({_meta('duration_s')} AS INTEGER), 0) AS d, coalesce(CAST({_meta('view_count')} AS BIGINT), 0) AS v FROM i WHERE plugin_type LIKE 'youtube%'),
    o AS (SELECT *, (d = 0 OR d BETWEEN 30 AND 3000) AND v >= 100 AS ok FROM g),
    p AS (SELECT *, sum(CAST(ok AS INT)) OVER w AS place, sum(CAST(NOT ok AS INT)) OVER w AS skipped FROM o WINDOW w AS (PARTITION BY source_name ORDER BY harvest_id ROWS UNBOUNDED PRECEDING))
    SELECT source_name, harvest_id, CAST(place AS BIGINT) AS place, CAST(skipped AS BIGINT) AS skipped FROM p WHERE ok AND place <= 10""",
    "freshness": f"""WITH {_ITEMS} SELECT source_name, count(*) FILTER (coalesce({_meta('upload_date')}, '') = '' OR {_meta('upload_date')} >= '20250310') AS fresh, count(*) AS total
    FROM i WHERE plugin_type LIKE 'youtube%' GROUP BY 1""",
    "harvest_report": """WITH n AS (SELECT source_name, count(DISTINCT harvest_id) AS items FROM raw_envelopes GROUP BY 1),
    s AS (SELECT name AS source_name, CASE WHEN NOT coalesce(enabled, TRUE) THEN 'skipped' WHEN coalesce(tenant_id, '') = '' THEN 'discarded'
      WHEN NOT coalesce(type IN ('x_twscrape', 'youtube_shorts', 'youtube_long'), FALSE) THEN 'unknown_plugin' ELSE 'ok' END AS status FROM source_configs)
    SELECT source_name, status, coalesce(items, 0) AS items, status <> 'ok' AS failed FROM s LEFT JOIN n USING (source_name)""",
    "plugin_config_counts": "SELECT coalesce(type, '') AS type, count(*) AS configured, coalesce(type, '') IN ('x_twscrape', 'youtube_shorts', 'youtube_long') AS known FROM source_configs GROUP BY ALL",
    "retention_ttl": "SELECT plugin_type, count(*) FILTER (harvested_at < TIMESTAMP '2025-04-10 00:00:00' - INTERVAL 504 HOUR) AS deleted, count(*) FILTER (harvested_at IS NULL OR harvested_at >= TIMESTAMP '2025-04-10 00:00:00' - INTERVAL 504 HOUR) AS kept FROM raw_envelopes GROUP BY 1",
    "envelope_flatten": "SELECT DISTINCT harvest_id, tenant_id, source_name, item.source_url AS source_url, item.title AS title, item.locale AS locale, CAST(len(item.media_urls) AS INTEGER) AS n_media FROM raw_envelopes",
    "metadata_json": f"WITH {_ITEMS} SELECT plugin_type, count({_meta('view_count')}) AS with_views, CAST(sum(coalesce(CAST({_meta('view_count')} AS BIGINT), 0)) AS BIGINT) AS views, coalesce(max(CAST({_meta('duration_s')} AS INTEGER)), 0) AS longest FROM i GROUP BY 1",
    "secret_mask": """WITH o AS (SELECT name, unnest(map_entries(options)) AS e FROM source_configs)
    SELECT name, e.key AS option, CASE WHEN regexp_matches(lower(e.key), 'token|cookie|key|secret|password|auth') THEN '***' ELSE e.value END AS value FROM o""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "tenant_funnel": """WITH e AS (SELECT DISTINCT tenant_id, plugin_type, harvest_id, source_name FROM raw_envelopes)
    SELECT tenant_id, plugin_type, count(*) AS items, count(DISTINCT source_name) AS sources, CAST(grouping(tenant_id, plugin_type) AS INTEGER) AS level FROM e GROUP BY ROLLUP (tenant_id, plugin_type)""",
}
