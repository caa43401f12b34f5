"""The table of sources, and routing by host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import url_host

#: Source, host that routes to it, host that validates it, extractor.
SOURCES = [
    ("books_to_scrape", "books.toscrape.com", "books.toscrape.com", "books-to-scrape-v1"),
    ("scrapeme_live", "scrapeme.live", "scrapeme.live", "scrapeme-live-v2"),
    ("scraping_sandbox", "scrapingsandbox.com", "scrapingsandbox.com", "scraping-sandbox-json-v1"),
    ("web_scraping_dev", "web-scraping.dev", "web-scraping.dev", None),
    ("scrapify_js", None, "scrapifydatalabs.com", "scrapify-js-json-v1"),
]
#: Rows of a lookup table that are broadcast at most.
BROADCAST = 100_000


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, routing_host string, validation_host string, extractor_version string")


def looked_up(lookup: DataFrame) -> DataFrame:
    """A lookup table with the broadcast hint while it is small; a shuffle join handles larger ones."""
    small = lookup.sparkSession is not None and lookup.limit(BROADCAST + 1).count() <= BROADCAST
    return F.broadcast(lookup) if small else lookup


def route_source(df: DataFrame, lookup: DataFrame | None = None, on_unknown: str = "flag", url: str = "source_url") -> DataFrame:
    """Add `source` by the URL's host; unknown hosts give null ('flag') or fail the job ('fail')."""
    lookup = sources(df.sparkSession) if lookup is None else lookup
    hosts = looked_up(lookup.filter("routing_host is not null").select(F.col("routing_host").alias("_host"), F.col("source").alias("_source")))
    found = df.join(hosts, url_host(F.col(url)) == F.col("_host"), "left").drop("_host")
    source = F.col("_source")
    if on_unknown == "fail":
        source = F.coalesce(source, F.raise_error(F.concat(F.lit("unsupported source: "), F.coalesce(F.col(url), F.lit("null")))))
    return found.withColumn("source", source).drop("_source")
