"""Sources: the raw lake, approved files, the source registry and an offline connector."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestream.functions.text import resolve_env
from lodestream.session import exists

ITEM = "STRUCT<source_url: STRING, title: STRING, content: STRING, locale: STRING, media_urls: ARRAY<STRING>, media_path: STRING, metadata: STRING>"
ENVELOPE = f"harvest_id STRING, tenant_id STRING, source_name STRING, plugin_type STRING, harvested_at TIMESTAMP, item {ITEM}"
APPROVED = "source_url STRING, title STRING, content STRING, clean_content STRING, locale STRING, tenant_id STRING, source_name STRING, harvest_id STRING"


def read_lake(spark: SparkSession, path: str, plugin: str | None = None) -> DataFrame:
    """All envelopes below ``path`` as JSON; unreadable files are dropped, a missing lake is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], ENVELOPE)
    rows = spark.read.schema(ENVELOPE).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(rows.plugin_type == plugin) if plugin else rows


def read_approved(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Approved items of those files that exist (top-level arrays become rows)."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        raise FileNotFoundError(", ".join(paths))
    return spark.read.schema(APPROVED).option("multiLine", True).json(there)


def load_sources(spark: SparkSession, path: str, env: dict[str, str] | None = None) -> DataFrame:
    """The source registry (JSON, or YAML where a parser is installed) with ``${NAME}`` resolved.

    Entries without name or type are skipped; of entries of one name the first holds.
    """
    text = Path(path).read_text()
    try:
        import yaml

        body = yaml.safe_load(text)
    except ImportError:
        body = json.loads(text)
    rows: dict[str, tuple] = {}
    for entry in (body or {}).get("sources", []):
        entry = resolve_env(entry, dict(os.environ) if env is None else env)
        if isinstance(entry, dict) and entry.get("name") and entry.get("type"):
            options = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (entry.get("options") or {}).items()}
            rows.setdefault(entry["name"], (entry["name"], entry["type"], entry.get("tenant_id"), bool(entry.get("enabled", True)), options))
    return spark.createDataFrame(list(rows.values()), "name STRING, type STRING, tenant_id STRING, enabled BOOLEAN, options MAP<STRING, STRING>")


def selected(sources: DataFrame, name: str | None = None, kind: str | None = None) -> DataFrame:
    """The sources of that name and that type; what is null selects all."""
    out = sources if name is None else sources.filter(sources.name == name)
    return out if kind is None else out.filter(out.type == kind)


class FixtureSource(DataSource):
    """A connector that reads stored listings instead of the network: one partition for each JSON-lines file of ``path``."""

    @classmethod
    def name(cls) -> str:
        return "fixture"

    def schema(self) -> str:
        return "file STRING, body STRING"

    def reader(self, schema):
        return _FixtureReader(self.options)


class _FixtureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.jsonl"))]

    def read(self, partition: InputPartition):
        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    yield Path(partition.value).name, line.rstrip("\n")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixtureSource)
