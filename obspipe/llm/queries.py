"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, lm, packing, phrases, pii, quality, secrets, sharding, simhash, substring, token_counts, vector_codes
from .common import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.prefix_tables(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "limit_chars")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pack(docs: DataFrame) -> DataFrame:
    pattern = importlib.import_module("public_tokenizers").PATTERN
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), pattern)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_simhash, op3_packing, op4_pii, op5_decontamination, op6_lm_scoring, op7_fingerprints, op8_sharding, op9_substring_dedup, op10_quality,
        op11_vector_codes, op12_secrets, op13_phrases,
    )
}

def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every part compared with every entry, one position a row; a round is two tables."""
    steps = [f"""rows as materialized (select row_number() over (order by vec_id, embedding) as i, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v
      from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
      f"""cells as materialized (select i, (j - 1) // (len(v) // {parts}) as part, (j - 1) % (len(v) // {parts}) as j, v[j] as x from (select *, unnest(range(1, len(v) + 1)) as j from rows))""",
      f"book0 as materialized (select part, i - 1 as entry, j, x from cells where i <= {entries})"]
    for r in range(rounds + 1):
        steps.append(f"""near{r} as materialized (select i, part, min_by(entry, far * {entries} + entry) as entry, min(far) as far
          from (select c.i, c.part, b.entry, cast(sum((c.x - b.x) * (c.x - b.x)) as bigint) as far from cells c join book{r} b on c.part = b.part and c.j = b.j group by all) group by all)""")
        if r < rounds:
            steps.append(f"""book{r + 1} as materialized (select part, entry, j, coalesce(m, b.x) as x from book{r} b left join (
              select n.part, n.entry, c.j, cast((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as m from near{r} n join cells c on n.i = c.i and n.part = c.part group by all) using (part, entry, j))""")
    return f"""with {", ".join(steps)}, each as (select vec_id, label, code, error from rows join (select i, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(far) as bigint) as error from near{rounds} group by i) using (i))
      select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
      (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, j)) from book{rounds}) as codebooks_sha256 from each"""


def _phrases_sql() -> str:
    words = r"""select coalesce(lang, 'und') as lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w
      from (select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)"""
    grams = " union all ".join(f"select lang, {k} as k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) as phrase from words" for k in range(1, 5))
    return f"""with words as materialized ({words}), counted as materialized (select lang, k, phrase, count(*) as a from ({grams}) group by all having count(*) >= 30),
      found as materialized (select *, string_split(phrase, ' ') as w from counted where k > 1),
      around as (select lang, phrase, max(a) as longest from (select lang, a, array_to_string(w[1:k - 1], ' ') as phrase from found union all select lang, a, array_to_string(w[2:k], ' ') from found) group by all),
      cuts as (select f.lang, f.phrase, f.a, c, array_to_string(w[1:c], ' ') as front, array_to_string(w[c + 1:k], ' ') as back from found f, (values (1), (2), (3)) t(c) where c < f.k),
      scores as (select cuts.*, l.a as l, r.a as r, cast(2000000 * cast(cuts.a as hugeint) // (l.a + r.a) as bigint) as score
        from cuts join counted l on l.lang = cuts.lang and l.phrase = front join counted r on r.lang = cuts.lang and r.phrase = back),
      lowest as (select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1),
      ranks as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from lowest left join around using (lang, phrase)
        where longest is null or 100 * longest < 80 * a)
      select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranks join (select lang, sum(len(w)) as n from words group by 1) using (lang) where rank <= 2000"""


ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _vector_codes_sql(), "op13_phrases": _phrases_sql()}
