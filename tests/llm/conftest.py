import pytest

ENVELOPE = "harvest_id string, tenant_id string, source_name string, plugin_type string, harvested_at timestamp, batch_no int, item struct<source_url: string, title: string, content: string, locale: string, media_urls: array<string>, media_path: string, metadata: string>"


@pytest.fixture(scope="session")
def envelopes(spark):
    """``envelopes(rows)`` of (harvest_id, source_name, batch_no, url, title, content, locale)."""

    def build(rows):
        full = [(h, "t", s, "x_twscrape", None, b, (u, t, c, loc, [], None, None)) for h, s, b, u, t, c, loc in rows]
        return spark.createDataFrame(full, ENVELOPE)

    return build
