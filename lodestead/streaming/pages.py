"""Page features over a stream of responses: extraction is stateless, so it runs as it is; sites are recomputed from the
page table, as cross-site features and medians need all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lodestead.config import FeatureConfig
from lodestead.operators.pages import html_pages, page_features


def stream_pages(fetch_log: DataFrame, path: str, checkpoint: str, config: FeatureConfig = FeatureConfig()) -> StreamingQuery:
    """Append page features to the table at ``path``, exactly once; fetch_log is a stream with ``site_domain``."""
    pages = html_pages(fetch_log).selectExpr("site_key", "seq as page_seq", "final_url as url", "site_domain", "html")
    writer = page_features(pages, config).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
