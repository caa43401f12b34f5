"""Extractor versions over the same evidence: what a version has already read, and how two versions differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RAW_FIELDS
from ..session import exists, new_folder
from .extract import EXTRACTORS, LANDED

#: Stands for a page's own address in the memo; extractors may give it out as a field.
ADDRESS = "\x00address"
PARSED = [*RAW_FIELDS, "categories_raw", "variants_raw", "error_code"]


def _placed(extracted: DataFrame, key: str) -> DataFrame:
    """extracted with `position`: the place of a row among those of its page, from 1, in the extractor's order."""
    order = Window.partitionBy(key).orderBy("_seq")
    return extracted.withColumn("_seq", F.monotonically_increasing_id()).withColumn("position", F.row_number().over(order)).drop("_seq")


def extract_memo(evidence: DataFrame, path: str, versions: list[str] | None = None) -> tuple[DataFrame, int]:
    """What `extract` gives, and how many bodies were parsed for it; bodies that a version has read before aren't parsed again.

    The memo at path is Parquet by extractor version, keyed by body_hash; it keeps what was read, whatever the pages'
    addresses, ids and times. Only hashes are compared: a body is read if its hash is new to the version, once for all
    pages that have it. A page without a hash isn't kept apart from others without one, so evidence must come from
    `capture_evidence`.
    """
    spark, out, parsed = evidence.sparkSession, [], 0
    for version, (source, run) in EXTRACTORS.items():
        if versions is not None and version not in versions:
            continue
        wanted, place = evidence.filter(F.col("source") == source), f"{path}/extractor={version}"
        new = wanted.select("body_hash").distinct()
        if exists(spark, place):
            new = new.join(spark.read.parquet(place).select("body_hash").hint("merge"), "body_hash", "left_anti")
        hashes = new_folder(spark, "hashes")
        new.write.parquet(hashes)
        new = spark.read.schema("body_hash string").parquet(hashes)
        count = new.count()
        if count:
            # hashes and memo grow with the pages: they are never sent to the driver, which a broadcast would do
            met = wanted.join(new.hint("merge"), "body_hash", "left_semi")
            # a page stands for all that have its body; its hash travels as the id
            once = met.select("body_hash", "body").dropDuplicates(["body_hash"])
            landed = {"evidence_id": F.col("body_hash"), "source_url": F.lit(ADDRESS), "fetched_at": F.lit(None).cast("timestamp")}
            pages = once.select(*[landed[c].alias(c) for c in LANDED], "body", F.lit(source).alias("source"))
            _placed(run(pages), "evidence_id").select(F.col("evidence_id").alias("body_hash"), "position", *PARSED).write.mode("append").parquet(place)
        parsed += count
        if not exists(spark, place):
            continue
        memo = spark.read.parquet(place).withColumn("extractor_version", F.lit(version))
        out.append(wanted.select(*LANDED, "source", "body_hash").join(memo.hint("merge"), "body_hash"))
    columns = ["evidence_id", "extractor_version", "source", "source_url", "observed_at", *PARSED]
    if not out:
        return next(iter(EXTRACTORS.values()))[1](evidence.filter("false")).select(*columns), parsed
    own = {f: F.when(F.col(f) == ADDRESS, F.col("source_url")).otherwise(F.col(f)).alias(f) for f in RAW_FIELDS}
    found = reduce(DataFrame.unionByName, out).withColumnRenamed("fetched_at", "observed_at")
    return found.select(*[own.get(c, F.col(c)) for c in columns]), parsed


def version_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a new version changes: evidence_id, position, field, old_value, new_value, a row for each field that differs.

    old, new: what two versions extract from the same evidence. Rows are aligned by their place on the page; a row that
    one side lacks shows as the field `record`. A failed page has its error_code and no fields. Lists are compared as JSON, empty ones as none;
    of variants only those that the other side lacks are shown.
    """
    fields = [*RAW_FIELDS, "categories_raw", "variants_raw"]
    sides = []
    for name, df in (("old", old), ("new", new)):
        kept = [F.when(F.col("error_code").isNull(), F.col(f)).alias(f) for f in fields]
        sides.append(_placed(df, "evidence_id").select(F.col("evidence_id").alias(f"_{name}_id"), F.col("position").alias(f"_{name}_at"), F.struct(*kept, "error_code").alias(name)))
    both = sides[0].join(sides[1], F.col("_old_id").eqNullSafe(F.col("_new_id")) & (F.col("_old_at") == F.col("_new_at")), "full_outer")
    one = lambda side, f: F.nullif(F.to_json(f"{side}.{f}"), F.lit("[]")) if f == "categories_raw" else F.col(f"{side}.{f}")
    written = lambda side: F.coalesce(F.transform(f"{side}.variants_raw", lambda v: F.to_json(v)), F.array())
    lacking = lambda a, b: F.nullif(F.array_join(F.array_except(written(a), written(b)), ","), F.lit(""))
    there = lambda side: F.when(F.col(side).isNotNull(), "present")
    rows = [("record", there("old"), there("new"))] + [(f, one("old", f), one("new", f)) for f in (*RAW_FIELDS, "categories_raw", "error_code")]
    rows.append(("variants_raw", lacking("old", "new"), lacking("new", "old")))
    each = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value")) for f, a, b in rows]), lambda x: ~x.old_value.eqNullSafe(x.new_value))
    return both.select(F.coalesce("_old_id", "_new_id").alias("evidence_id"), F.coalesce("_old_at", "_new_at").alias("position"), F.explode(each).alias("x")).select("evidence_id", "position", "x.*")
