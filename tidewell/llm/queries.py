"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import (
    line_dedup,
    media,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash,
    token_counts,
    url_filters,
)

Query = Callable[[SparkSession, str], DataFrame]

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Target weights of the mix: three sources by name, and the rest together, which each have an equal part of it.
WEIGHTS = {"src0": 5, "src1": 3, "src2": 2, mixing.OTHERS: 10}
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"
CAPACITY, TOKEN_LIMIT = 4096, 4096


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer(WORD_BPE), CAPACITY)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.parse_rule(verdict, text) for verdict, text in RULES]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return url_filters.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), table)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir), secret_scan.ranked_words(tokenizer(WORD_BPE)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer(PIECE_BPE), TOKEN_LIMIT)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.slots(docs, mixing.by_source(docs, WEIGHTS), ["doc_id"])


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.encode(documents(spark, sf_dir)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_url_filters,
        op3_quality_classifier,
        op4_secret_scan,
        op5_token_counts,
        op6_line_dedup,
        op7_quality_rules,
        op8_mixing,
        op9_media,
        op10_simhash,
    )
}

#: White space of the contracts, for DuckDB.
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": f"""
        WITH rules(host, path, verdict) AS (VALUES
            {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in (url_filters.parse_rule(v, t) for v, t in RULES))}),
        cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parts AS (
            SELECT page_id,
                   {ASCII_LOWER.format("coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')")} AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM cut),
        fit AS (
            SELECT p.page_id, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
            FROM parts p JOIN rules r
              ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            GROUP BY p.page_id)
        SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fit f ON p.page_id = f.page_id
    """,
    "op6_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
        keyed AS (SELECT doc_id, pos, line, {ASCII_LOWER.format(f"trim(line, {BLANKS})")} AS key FROM line),
        twice AS (
            SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {line_dedup.LEAST}
            GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        flagged AS (
            SELECT k.doc_id, k.pos, k.line, t.first IS NOT NULL AND k.doc_id > t.first AS dropped
            FROM keyed k LEFT JOIN twice t ON k.key = t.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM flagged GROUP BY doc_id
    """,
}
