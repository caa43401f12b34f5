"""Normalisation: raw strings to typed columns, one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, canonical_url, parse_availability, parse_price, py_strip
from ..schemas import OPTIONS, VARIANTS
from ..session import once


def merge_categories(categories: Column, category: Column) -> Column:
    """Stripped, without blanks and repeats, in order; the single category comes last."""
    every = F.concat(F.coalesce(categories, F.array().cast("array<string>")), F.array(category))
    return F.array_distinct(F.filter(F.transform(every, py_strip), lambda x: x.isNotNull() & (x != "")))


def variant_key(sku: Column, options: Column) -> Column:
    joined = F.array_join(F.transform(F.array_sort(options), lambda o: F.concat(F.lower(o["name"]), F.lit("="), o["value"])), "|")
    return F.when(sku.isNotNull(), F.concat(F.lit("sku:"), sku)).when(F.size(options) > 0, F.concat(F.lit("options:"), joined))


def normalize_variants(source: Column, variants: Column, currency_raw: Column) -> Column:
    def one(v: Column) -> Column:
        sku = blank_to_null(v["sku_raw"])
        stripped = F.transform(v["options_raw"], lambda o: F.struct(py_strip(o["name"]).alias("name"), py_strip(o["value"]).alias("value")))
        options = F.filter(F.coalesce(stripped, F.array().cast(OPTIONS)), lambda o: (o["name"] != "") & (o["value"] != ""))
        return F.struct(
            variant_key(sku, options).alias("key"), sku.alias("sku"), options.alias("options"),
            parse_price(v["price_raw"], currency_raw)["amount"].alias("price"), parse_availability(source, v["availability_raw"])["availability"].alias("availability"),
        )

    return F.transform(F.coalesce(variants, F.array()), one).cast(VARIANTS)


def normalize(observed: DataFrame) -> DataFrame:
    """Observations to normalised rows; lineage passes through."""
    c = F.col
    ready = once(observed, ["*"], {
        "_price": parse_price(c("price_raw"), c("currency_raw")), "_compare": parse_price(c("compare_at_price_raw"), c("currency_raw")),
        "_stock": parse_availability(c("source"), c("availability_raw")), "_rid": blank_to_null(c("source_record_id_raw")),
        "_variants": normalize_variants(c("source"), c("variants_raw"), c("currency_raw")),
    })
    raw_url = c("canonical_product_url_raw")
    url = F.when(raw_url.isNotNull(), canonical_url(raw_url)).when(c("_rid").isNull(), canonical_url(c("source_url")))
    return ready.select(
        "evidence_id", "extractor_version", "source", "source_url", url.alias("canonical_product_url"), c("_rid").alias("source_record_id"),
        "observed_at", py_strip(c("title_raw")).alias("title"), c("_price.amount").alias("price"),
        F.when(c("_compare.currency").eqNullSafe(c("_price.currency")), c("_compare.amount")).alias("compare_at_price"),
        c("_price.currency").alias("currency"), c("_stock.availability").alias("availability"), c("_stock.quantity").alias("quantity"),
        blank_to_null(c("category_raw")).alias("category"), blank_to_null(c("sku_raw")).alias("sku"),
        merge_categories(c("categories_raw"), c("category_raw")).alias("categories"),
        c("_variants").alias("variants"),
    )
