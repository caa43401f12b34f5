"""Validation: an ordered list of error codes for each row; any error rejects it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, url_host
from ..sources.lookup import looked_up, sources


def variant_errors(variants: Column) -> Column:
    """At most one code per variant, in order."""
    keys = F.transform(variants, lambda v: v["key"])

    def one(v: Column, i: Column) -> Column:
        return (
            F.when(F.coalesce(v["key"], F.lit("")) == "", "MISSING_VARIANT_IDENTITY")
            .when(F.array_position(keys, v["key"]) < i + 1, "DUPLICATE_VARIANT_IDENTITY")
            .when(v["price"].isNull() | (v["price"] < 0), "INVALID_VARIANT_PRICE")
            .when(v["availability"].isNull(), "INVALID_VARIANT_AVAILABILITY")
        )

    return F.transform(variants, one)


def validation_errors(host: Column) -> Column:
    """Codes of a normalised row; host: the validating host of its source, null if unknown."""
    c = F.col
    url, rid = c("canonical_product_url"), c("source_record_id")
    url_ok = F.coalesce((url_host(url) == host) & url.rlike(r"(?i)^https?://[^/?#]*/"), F.lit(False))
    low, compare = c("price") < 0, c("compare_at_price")
    checks = [
        ("MISSING_TITLE", F.coalesce(py_strip(c("title")), F.lit("")) == ""),
        ("MISSING_PRICE", c("price").isNull()),
        ("NEGATIVE_PRICE", low),
        ("NEGATIVE_COMPARE_AT_PRICE", compare < 0),
        ("COMPARE_AT_BELOW_PRICE", (compare >= 0) & (compare < c("price"))),
        ("MISSING_CURRENCY", c("currency").isNull()),
        ("UNKNOWN_AVAILABILITY", c("availability").isNull()),
        ("NEGATIVE_QUANTITY", c("quantity") < 0),
        ("INCONSISTENT_AVAILABILITY_QUANTITY", (c("availability") == "OUT_OF_STOCK") & (c("quantity") != 0)),
        ("UNKNOWN_SOURCE", host.isNull()),
        ("MISSING_IDENTITY", (F.coalesce(rid, F.lit("")) == "") & ~url_ok),
        ("INVALID_CANONICAL_URL", url.isNotNull() & ~url_ok),
    ]
    product = F.array(*[F.when(cond, F.lit(code)) for code, cond in checks])
    return F.array_compact(F.concat(product, F.coalesce(variant_errors(c("variants")), F.array().cast("array<string>"))))


def identity_key(rid: Column, url: Column) -> Column:
    """Key of a product within its source."""
    return F.coalesce(F.concat(F.lit("id:"), F.nullif(rid, F.lit(""))), F.concat(F.lit("url:"), F.nullif(url, F.lit(""))))


def validate(normalized: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Add identity, identity_key, errors and is_valid; accepted rows get a source_url in any case."""
    lookup = sources(normalized.sparkSession) if lookup is None else lookup
    hosts = looked_up(lookup.select(F.col("source").alias("_source"), F.col("validation_host").alias("_host")))
    rows = normalized.join(hosts, F.col("source") == F.col("_source"), "left")
    rows = rows.withColumn("errors", validation_errors(F.col("_host"))).drop("_source", "_host").withColumn("is_valid", F.size("errors") == 0)
    url, rid = F.col("canonical_product_url"), F.col("source_record_id")
    own = F.coalesce(F.nullif("source_url", F.lit("")), F.nullif(url, F.lit("")), F.lit(""))
    return rows.withColumns({
        "identity": F.when(F.col("is_valid"), F.struct("source", "canonical_product_url", "source_record_id")),
        "identity_key": F.when(F.col("is_valid"), identity_key(rid, url)),
        "source_url": F.when(F.col("is_valid"), own).otherwise(F.col("source_url")),
    })


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, rejected rows."""
    return validated.filter("is_valid"), validated.filter("not is_valid")
