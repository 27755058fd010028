"""The registered queries of the corpus operators with their SQL, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.llm import exact_dedup as dedup
from pitloom.llm import language_id, lattice_lm, mixing, near_dedup, pii, piece_codec, secret_scan, spelling_variants, substring_dedup, suffix_dedup, token_alignment, topk_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@_query("op1_exact_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_table(spark, sf_dir, "documents"))


@_query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


@_query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


@_query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(_table(spark, sf_dir, "documents"))


@_query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents")).drop("row_key")


OP5_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query("op5_exact_top_k", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_index.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


@_query("op10_lattice_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(_table(spark, sf_dir, "documents"))


@_query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(_table(spark, sf_dir, "documents"), declared=F.col("lang"), address=F.col("source"))
    return found.select("doc_id", "declared", "lang", "text_lang", F.round("posterior", 6).alias("posterior"), "accepted")


@_query("language_of_pages")
def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page: its text with markup taken out, its html element's language, its address."""
    pages = _table(spark, sf_dir, "pages").withColumn("text", F.regexp_replace("html", "(?s)<[^>]*>", " "))
    found = language_id.identify(pages, doc_id="page_id", declared=language_id.markup_language(F.col("html")), address=F.col("url"))
    return found.select(F.col("doc_id").alias("page_id"), "declared", "lang", "text_lang", F.round("posterior", 6).alias("posterior"), "accepted")


#: Bisection by recursion on the table of sources: 30 halvings for either bound.
OP7_SQL = r"""
WITH RECURSIVE r AS (
    SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
           ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
    FROM documents
), s AS (
    SELECT source, sum(n_tokens)::BIGINT AS tokens, ceil(count(*) / 512.0)::BIGINT AS n_blocks,
           sum(n_tokens) / (SELECT greatest(sum(n_tokens), 1)::DOUBLE FROM r) AS share
    FROM r GROUP BY source
), h AS (SELECT list(share ORDER BY source) AS v, count(*) AS n FROM s WHERE tokens > 0),
e(step, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
    FROM (
        SELECT step, low, high, mid,
               ln(list_sum(list_transform(v, lambda x: pow(x, mid)))) - list_sum(list_transform(v, lambda x: pow(x, mid) * mid * ln(x))) / list_sum(list_transform(v, lambda x: pow(x, mid)))
                   >= 0.95 * ln(n) - 1e-12 AS ok
        FROM (SELECT step, low, high, (low + high) / 2 AS mid, v, n FROM e, h WHERE step < 30)
    )
), m(step, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
    FROM (
        SELECT step, low, high, mid,
               list_max(list_transform(v, lambda x: pow(x, mid) / x)) / list_sum(list_transform(v, lambda x: pow(x, mid))) <= 2.0 + 1e-12 AS ok
        FROM (SELECT step, low, high, (low + high) / 2 AS mid, v FROM m, h WHERE step < 30)
    )
), x AS (
    SELECT CASE WHEN n < 2 THEN 1.0 ELSE greatest(
        CASE WHEN -list_sum(list_transform(v, lambda y: y * ln(y))) >= 0.95 * ln(n) - 1e-12 THEN 1.0 ELSE (SELECT low FROM e WHERE step = 30) END,
        CASE WHEN list_max(list_transform(v, lambda y: 1 / y)) / n <= 2.0 + 1e-12 THEN 0.0 ELSE (SELECT high FROM m WHERE step = 30) END) END AS exponent
    FROM h
), w AS (
    SELECT source, tokens, n_blocks, exponent, CASE WHEN tokens > 0 THEN pow(share, exponent) ELSE 0 END AS power FROM s, x
), p AS (
    SELECT source, tokens, n_blocks, exponent, power / (SELECT sum(power) FROM w) AS weight,
           floor(power / (SELECT sum(power) FROM w) * (SELECT sum(tokens) FROM s) + 1e-6)::BIGINT AS budget FROM w
), q AS (
    SELECT source, n_blocks, exponent, weight, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes,
           CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM p
), d AS (SELECT r.*, place % n_blocks AS block, exponent, weight, passes, rest FROM r JOIN q USING (source)),
b AS (
    SELECT source, block, block_tokens, row_number() OVER o AS block_place, sum(block_tokens) OVER o - block_tokens AS before
    FROM (SELECT source, block, sum(n_tokens) AS block_tokens FROM d GROUP BY source, block)
    WINDOW o AS (PARTITION BY source ORDER BY md5('mix:' || source || ':' || block::VARCHAR), block ROWS UNBOUNDED PRECEDING)
)
SELECT doc_id, source, n_tokens, exponent, round(weight, 9) AS weight, block, block_place,
       (passes + CASE WHEN block_tokens <= rest - before THEN 1
                      WHEN rest - before > 0 AND sum(n_tokens) OVER (PARTITION BY source, block ORDER BY place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= rest - before THEN 1
                      ELSE 0 END)::BIGINT AS copies
FROM d JOIN b USING (source, block)
"""


@_query("op7_source_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("row_key")


@_query("op11_suffix_array_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


@_query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(_table(spark, sf_dir, "documents"))


@_query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokenizers(_table(spark, sf_dir, "documents"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
