"""The registered queries of the text operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (bpe, counts, fingerprints, interactions, jaccard, lm, mixing, neighbours, substrings, toxicity, urls, variants,
                          vectors)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = "VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')"


@query("op1_url_filter", f"""
WITH rules(rule, verdict) AS ({URL_RULES}),
parts AS (SELECT rule, verdict, split_part(rule, '/', 1) AS r_host, substr(rule, strpos(rule, '/')) AS r_path FROM rules),
rest AS (
    SELECT page_id, row_number() OVER () AS n,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (
    SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (
    SELECT s.page_id, s.host, s.path, r.rule, r.verdict,
           row_number() OVER (PARTITION BY s.n ORDER BY length(r.rule) DESC NULLS LAST) AS k
    FROM seen s LEFT JOIN parts r ON (s.host = r.r_host OR ends_with(s.host, '.' || r.r_host)) AND starts_with(s.path, r.r_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT col1 AS rule, col2 AS verdict FROM {URL_RULES}")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return urls.judge(pages, rules).withColumnRenamed("id", "page_id")


@query("op3_fingerprint")
def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_ngram_jaccard")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = substrings.removals(docs).withColumnRenamed("doc_id", "cut_id")
    return (docs.select("doc_id").join(cut, F.col("doc_id") == F.col("cut_id"), "left")
            .select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
                    F.coalesce("removed_words", F.lit(0)).alias("removed_words"), "sources"))


@query("op8_embedding_near_dedup")
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dedup(table(spark, sf_dir, "embeddings"))


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.measures(table(spark, sf_dir, "documents"))
    mixed = mixing.decide(found, mixing.even_targets(found))
    return mixed.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
                        F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op11_filter_interactions", r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT row, doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
             + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > first, false)::INT AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM e a, e b, e c, e d, e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65)) AS own,
             list_sum([1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, 6) IF i < step]) AS found FROM o, range(1, 6) r(step)),
p AS (SELECT *, coalesce(found, 0)::INT AS behind FROM s),
k AS (SELECT part, filter_order, step, own, sum(CASE WHEN fails & (behind | own) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN fails & own > 0 AND fails & behind = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails & own > 0 AND fails & behind > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails & own > 0 AND fails & behind = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN fails & own > 0 AND fails & behind = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, p GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM k
""")
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.words(table(spark, sf_dir, "documents")))


@query("op13_nearest_neighbours")
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_ = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors_, vectors_.where("vec_id % 50 = 0"))
