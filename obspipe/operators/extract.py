"""Extraction: evidence to raw observations, by versioned extractors, with a table of failures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, py_strip
from ..schemas import FAILURE, LINEAGE, OPTIONS, RAW_FIELDS, VARIANTS_RAW
from ..session import once, prepared
from .html import select_text


#: What extractors need of evidence besides the body.
LANDED = ["evidence_id", "source_url", "fetched_at"]


def shaped(df: DataFrame, version: str, source: str, fields: dict[str, Column], error: Column) -> DataFrame:
    """Observation columns plus error_code; a row with a code is a failure."""
    cols = {f: F.lit(None).cast("string") for f in RAW_FIELDS}
    cols |= {"categories_raw": F.array().cast("array<string>"), "variants_raw": F.array().cast(VARIANTS_RAW)} | fields
    lineage = ["evidence_id", F.lit(version).alias("extractor_version"), F.lit(source).alias("source"), "source_url", F.col("fetched_at").alias("observed_at")]
    return once(df, lineage, cols | {"error_code": error})


def _one(name: str) -> Column:
    return F.nullif(F.get(F.col("found")[name], F.lit(0)), F.lit(""))


def extract_books(evidence: DataFrame) -> DataFrame:
    main = ["div.product_main"]
    rules = {
        "main": {"of": main}, "title": {"of": main, "select": ["h1"]}, "price": {"of": main, "select": ["p.price_color"]},
        "stock": {"of": main, "select": ["p.instock.availability"]}, "category": {"of": ["ul.breadcrumb"], "select": ["a"], "pick": "last"},
    }
    rows = evidence.withColumn("found", select_text(F.col("body"), rules))
    fields = {"title_raw": _one("title"), "price_raw": _one("price"), "availability_raw": _one("stock"), "category_raw": _one("category")}
    return shaped(rows, "books-to-scrape-v1", "books_to_scrape", fields, F.when(F.col("found.main").isNull(), "PRODUCT_MAIN_NOT_FOUND"))


def extract_woo(evidence: DataFrame) -> DataFrame:
    main = ["div.summary.entry-summary", "div.summary"]
    rules = {
        "main": {"of": main}, "title": {"of": main, "select": ["h1.product_title", "h1"]}, "price": {"of": main, "select": ["p.price"]},
        "stock": {"of": main, "select": ["p.stock"]}, "sku": {"of": main, "select": [".sku"]}, "tags": {"of": main, "select": [".posted_in a"], "pick": "all"},
    }
    rows = evidence.withColumn("found", select_text(F.col("body"), rules))
    fields = {
        "title_raw": _one("title"), "price_raw": _one("price"), "availability_raw": _one("stock"), "sku_raw": _one("sku"),
        "categories_raw": F.coalesce(F.col("found.tags"), F.array().cast("array<string>")),
    }
    return shaped(rows, "scrapeme-live-v2", "scrapeme_live", fields, F.when(F.col("found.main").isNull(), "PRODUCT_SUMMARY_NOT_FOUND"))


def _kind(v: Column) -> Column:
    """Type of a variant value: null where missing, VOID for JSON null."""
    return F.schema_of_variant(v)


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _string(v: Column, key: str) -> Column:
    return let(_at(v, key), lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _flag(v: Column, key: str) -> Column:
    return let(_at(v, key), lambda x: F.when(_kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "string")))


def _number(v: Column, key: str, binary: bool = False) -> Column:
    """A JSON number as plain digits, a string as it is, anything else null.

    binary: numbers whose shortest binary form needs an exponent are null, as later steps refuse it.
    """
    def plain(p: Column) -> Column:
        kind, value = p["kind"], p["value"]
        digits = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        size = F.abs(value)
        odd = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (size > 0) & ((size >= F.lit("1e16").cast("decimal(38,18)")) | (size < F.lit("0.0001").cast("decimal(38,18)")))
        fits = ~odd if binary else F.lit(True)
        return F.when(kind == "STRING", p["text"]).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & fits, digits)

    read = lambda x: F.struct(_kind(x).alias("kind"), F.try_variant_get(x, "$", "decimal(38,18)").alias("value"), F.try_variant_get(x, "$", "string").alias("text"))
    return let(_at(v, key), lambda x: let(read(x), plain))


def extract_catalog_json(evidence: DataFrame) -> DataFrame:
    """A JSON catalog to one observation per product; any wrong record fails the whole catalog."""
    prepared(evidence.sparkSession)
    rows = once(evidence, LANDED, {"doc": F.try_parse_json("body")})
    rows = once(rows, [*LANDED, "doc"], {"items": F.when(F.coalesce(_kind(_at(F.col("doc"), "products")).startswith("ARRAY"), F.lit(False)), F.try_variant_get("doc", "$.products", "array<variant>"))})
    bad = F.array_position(F.transform("items", lambda v: F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))), False)
    error = (
        F.when(F.col("doc").isNull(), "INVALID_JSON").when(F.col("items").isNull(), "PRODUCTS_ARRAY_NOT_FOUND")
        .when(bad > 0, F.concat(F.lit("INVALID_PRODUCT_RECORD:"), (bad - 1).cast("string")))
    )
    rows = once(rows, [*LANDED, "items"], {"error": error})
    # a failed catalog is one row, an empty one none
    rows = rows.withColumn("item", F.explode(F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.col("items"))))
    v = F.col("item")
    fields = {
        "title_raw": _string(v, "title"), "price_raw": _number(v, "price"), "availability_raw": _flag(v, "in_stock"),
        "category_raw": _string(v, "category"), "currency_raw": _string(v, "currency"), "source_record_id_raw": _string(v, "id"),
    }
    return shaped(rows, "scrapify-js-json-v1", "scrapify_js", fields, F.col("error"))


def extract_embedded_json(evidence: DataFrame) -> DataFrame:
    """The first fitting JSON object in a pre element to one observation with variants."""
    prepared(evidence.sparkSession)
    rows = evidence.select(*LANDED, select_text(F.col("body"), {"pre": {"select": ["pre"], "pick": "all", "join": ""}}).alias("found"))
    texts = F.filter("found.pre", lambda t: t.startswith("{") & F.contains(t, F.lit('"variants"')))
    parsed = F.filter(F.transform(texts, F.try_parse_json), lambda v: _kind(v).startswith("OBJECT") & _kind(_at(v, "id")).isNotNull() & _kind(_at(v, "title")).isNotNull())
    rows = once(rows, LANDED, {"doc": F.get(parsed, F.lit(0))})
    rows = once(rows, [*LANDED, "doc"], {"items": F.when(F.coalesce(_kind(_at(F.col("doc"), "variants")).startswith("ARRAY"), F.lit(False)), F.try_variant_get("doc", "$.variants", "array<variant>"))})
    wrong = F.exists("items", lambda v: ~F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)))
    error = F.when(F.col("doc").isNull(), "PRODUCT_JSON_NOT_FOUND").when(F.col("items").isNull(), "VARIANTS_NOT_LIST").when(wrong, "VARIANT_NOT_OBJECT")

    def variant(v: Column) -> Column:
        options = F.array(*[F.struct(F.lit(n).alias("name"), _string(v, n).alias("value")) for n in ("color", "size")])
        kept = F.filter(options, lambda o: o["value"].isNotNull() & (py_strip(o["value"]) != "")).cast(OPTIONS)
        return F.struct(_string(v, "sku").alias("sku_raw"), _number(v, "price", True).alias("price_raw"), _flag(v, "inStock").alias("availability_raw"), kept.alias("options_raw"))

    doc = F.col("doc")
    rid = F.when(_kind(_at(doc, "id")) == "BIGINT", F.try_variant_get(doc, "$.id", "string")).otherwise(_string(doc, "id"))
    category = _string(doc, "category")
    none = F.array().cast("array<string>")
    fields = {
        "title_raw": _string(doc, "title"), "price_raw": _number(doc, "price", True), "availability_raw": _flag(doc, "inStock"), "category_raw": category,
        "currency_raw": F.lit("USD"), "source_record_id_raw": rid, "canonical_product_url_raw": F.col("source_url"),
        "compare_at_price_raw": _number(doc, "compareAtPrice", True), "sku_raw": _string(doc, "sku"),
        "categories_raw": F.when(F.coalesce(category, F.lit("")) != "", F.array(category)).otherwise(none),
        "variants_raw": F.when(error.isNull(), F.transform("items", variant)).cast(VARIANTS_RAW),
    }
    return shaped(rows, "scraping-sandbox-json-v1", "scraping_sandbox", fields, error)


#: Extractors by version; new behaviour is a new version. Each takes evidence and returns observation columns and error_code.
EXTRACTORS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "books-to-scrape-v1": ("books_to_scrape", extract_books),
    "scrapeme-live-v2": ("scrapeme_live", extract_woo),
    "scrapify-js-json-v1": ("scrapify_js", extract_catalog_json),
    "scraping-sandbox-json-v1": ("scraping_sandbox", extract_embedded_json),
}


def extract(evidence: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """All observations and failures of evidence that has a `source` column (routing happens before).

    The filter on source stands below the extractor, so a page is only parsed by its own.
    """
    each = [f(evidence.filter(F.col("source") == source)) for v, (source, f) in EXTRACTORS.items() if versions is None or v in versions]
    return reduce(DataFrame.unionByName, each)


def observations(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error_code is null").select(*LINEAGE, *RAW_FIELDS, "categories_raw", "variants_raw")


def extraction_failures(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error_code is not null").select(*[c.split()[0] for c in FAILURE.split(", ")])


