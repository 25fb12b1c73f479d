import datetime as dt
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestream import session
from lodestream.functions.text import mask_secrets
from lodestream.operators import lake
from lodestream.sources import readers
from lodestream.streaming.ingest import event_counts, ingest_stream

T0 = dt.datetime(2025, 3, 1)


def envelopes(spark, rows):
    return spark.createDataFrame([(h, t, "s", "x_twscrape", at, (f"u{h}", "t", c, None, [], None, "{}")) for h, t, at, c in rows], readers.ENVELOPE)


def test_payload_falls_back(spark):
    items = spark.createDataFrame([("", "body", None, None, "extra"), ("clean", "body", "own", "url", "extra")], "clean_content string, content string, tenant_id string, source_url string, id string")
    got = {(r["text"], r["tenant_id"], r["source_url"], r["locale"]) for r in lake.payloads(items, "fallback").collect()}
    assert got == {("body", "fallback", "", ""), ("clean", "own", "url", "")}


def test_upsert_is_idempotent(spark, tmp_path):
    items = spark.createDataFrame([("c one", "a"), ("c one", "a"), ("c two", "a")], "content string, tenant_id string")
    path = str(tmp_path / "points")
    points = lake.payloads(items, "a")
    assert lake.upsert(spark, points, path, ["chunk_no"]) == 3
    assert lake.upsert(spark, points, path, ["chunk_no"]) == 3
    assert lake.read_collection(spark, path).count() == 2
    assert lake.upsert(spark, points.limit(0), path, ["chunk_no"]) == 0


def test_upsert_writes_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, chunk_no int, text string, tenant_id string")
    assert lake.upsert(spark, rows(("1", 0, "a", "t"), ("2", 0, None, "t")), path, ["chunk_no"]) == 2
    lake.upsert(spark, rows(("1", 0, "a", "t"), ("2", 0, None, "t")), path, ["chunk_no"])
    assert spark.read.parquet(path).count() == 2
    lake.upsert(spark, rows(("1", 0, "b", "t"), ("3", 0, "c", "u")), path, ["chunk_no"])
    want = [("1", "b"), ("2", None), ("3", "c")]
    shown = lambda: sorted((r["id"], r["text"]) for r in lake.read_collection(spark, path).collect())
    assert spark.read.parquet(path).count() == 4 and shown() == want
    lake.compact(spark, path)
    assert spark.read.parquet(path).count() == 3 and shown() == want


def test_collection_knows_its_dimension(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id int, vector array<float>")
    assert lake.check_dimension(v.filter("id < 3"), 2).count() == 1
    with pytest.raises(Exception, match="collection of 2"):
        lake.check_dimension(v, 2).collect()


def test_retention_deletes(spark, tmp_path):
    path = str(tmp_path / "lake")
    late = T0 + dt.timedelta(hours=80)
    lake.land(envelopes(spark, [("1", "a", T0, "x"), ("2", "a", late, "x"), ("3", "b", T0, "x"), ("4", "c", late, "x"), ("5", "a", None, "x")]), path)
    now = F.lit("2025-03-05 00:00:00").cast("timestamp")
    assert lake.delete_expired(spark, path, now, 0) == 0 and lake.delete_expired(spark, path, now) == 2
    assert {r["harvest_id"] for r in spark.read.parquet(path).collect()} == {"2", "4", "5"} and not (tmp_path / "lake" / "tenant_id=b" / "plugin_type=x_twscrape").exists()
    assert lake.delete_expired(spark, path, now) == 0


def test_retention(spark):
    e = envelopes(spark, [("1", "a", T0, "x"), ("2", "a", T0 + dt.timedelta(hours=80), "x"), ("3", "a", None, "x")])
    now = F.lit("2025-03-05 00:00:00").cast("timestamp")
    assert {r["harvest_id"] for r in lake.retain(e, now).collect()} == {"2", "3"}
    assert lake.retain(e, now, 0).count() == 3
    r = lake.retention_report(e, now).first()
    assert (r["deleted"], r["kept"]) == (1, 2)


def test_status_gates_and_report(spark):
    s = spark.createDataFrame([("a", "x_twscrape", "t", True), ("b", "x_twscrape", "t", False), ("c", "x_twscrape", None, True), ("d", "odd", "t", None)], "name string, type string, tenant_id string, enabled boolean")
    e = envelopes(spark, [("1", "t", T0, "x"), ("1", "t", T0, "x")]).withColumn("source_name", F.lit("a"))
    got = {r["source_name"]: (r["status"], r["items"], r["failed"]) for r in lake.harvest_report(s, e, ["x_twscrape"]).collect()}
    assert got == {"a": ("ok", 1, False), "b": ("skipped", 0, True), "c": ("discarded", 0, True), "d": ("unknown_plugin", 0, True)}


def test_lake_files(spark, tmp_path):
    lake.land(envelopes(spark, [("1", "a", T0, "x"), ("2", "b", T0, None)]), str(tmp_path / "lake"), "json")
    assert readers.read_lake(spark, str(tmp_path / "none")).count() == 0
    raw = tmp_path / "raw" / "a" / "x_twscrape"
    raw.mkdir(parents=True)
    (raw / "1.json").write_text(json.dumps({"harvest_id": "1", "tenant_id": "a", "plugin_type": "x_twscrape", "item": {"content": "c"}}))
    assert [r["item"]["content"] for r in readers.read_lake(spark, str(tmp_path / "raw"), "x_twscrape").collect()] == ["c"]
    (tmp_path / "ok.json").write_text(json.dumps([{"content": "a"}, {"content": "b", "extra": 1}]))
    assert readers.read_approved(spark, [str(tmp_path / "ok.json"), str(tmp_path / "none.json")]).count() == 2


def test_no_local_folder_on_a_cluster():
    named = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda k, d: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(named(master))


def test_registry_and_fixture_source(spark, tmp_path):
    (tmp_path / "sources.json").write_text(json.dumps({"sources": [{"name": "a", "type": "x", "tenant_id": "t", "options": {"api_token": "${TOKEN}", "n": 3, "m": "${NONE}"}}, {"type": "broken"}, {"name": "a", "type": "second"}]}))
    df = readers.load_sources(spark, str(tmp_path / "sources.json"), {"TOKEN": "secret"})
    assert readers.selected(df, "a", "x").count() == 1 and readers.selected(df, kind="y").count() == 0
    assert df.count() == 1 and df.first()["options"] == {"api_token": "secret", "n": "3", "m": "${NONE}"}
    assert df.select(mask_secrets(F.col("options")).alias("o")).first()["o"]["api_token"] == "***"
    (tmp_path / "one.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    readers.register(spark)
    assert spark.read.format("fixture").option("path", str(tmp_path)).load().count() == 2


def test_streaming_ingest(spark, tmp_path):
    lake_dir = str(tmp_path / "lake")
    envelopes(spark, [("1", "a", T0, "hello there"), ("1", "a", T0, "hello there"), ("2", "a", T0, "other")]).write.parquet(lake_dir)
    q = ingest_stream(spark, lake_dir, str(tmp_path / "points"), str(tmp_path / "cp"), "a")
    q.awaitTermination(120)
    assert lake.read_collection(spark, str(tmp_path / "points")).count() == 2
    ev = spark.createDataFrame([(T0, "a", 1.0), (T0, "a", 2.0), (None, "b", None)], "ts timestamp, event_type string, value double")
    assert [(r["n"], r["total"]) for r in event_counts(ev).collect()] == [(2, 3.0)]
