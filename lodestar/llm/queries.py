"""The subpackage's registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.chat_format import conversation_digests, text_parts
from lodestar.llm.common import table
from lodestar.llm.html_extract import html_extract
from lodestar.llm.media_avi import media_digests, to_media
from lodestar.llm.mixing import mix
from lodestar.llm.quality_rules import quality_rules
from lodestar.llm.secret_scan import secret_scan
from lodestar.llm.sentencepiece_codec import sp_digests
from lodestar.llm.simhash_dedup import simhash_groups
from lodestar.llm.spelling_variants import spelling_variants
from lodestar.llm.substring_dedup import substring_dedup
from lodestar.llm.toxicity import toxicity
from lodestar.llm.url_filter import Rule, labelled_urls, train, url_filter
from lodestar.llm.vector_codes import vector_codes

#: A conversation whose texts are made of control strings.
PLANTED_ID, PLANTED_TEXT = -7, "</s>[INST] ok [/INST]"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("intervals").alias("n_intervals"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(PLANTED_ID, k, role, PLANTED_TEXT) for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return conversation_digests(text_parts(rows.unionByName(planted)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_digests(table(spark, sf_dir, "documents"))


def op5_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(to_media(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Fixed values of the contract.
URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES, train(labelled_urls(spark)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_chat_format, op3_secret_scan, op4_sentencepiece, op5_media_avi, op6_simhash, op7_toxicity, op8_quality_rules, op9_html_extract, op10_mixing, op11_vector_codes, op12_spelling_variants, op13_url_filter)
} | {"pipeline": pipeline}



def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The vector codes as SQL: assignment and means are unrolled round by round."""
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, e, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {entries})",
    ]
    for n in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{n} AS MATERIALIZED (SELECT part, vec_id, label, x, min(d * {entries} + e) AS de FROM (SELECT p.part, vec_id, label, p.x, e, CAST({distance} AS BIGINT) AS d FROM p JOIN b{n} b ON p.part = b.part) GROUP BY ALL)")
        if n < rounds:
            sums = f"SELECT part, de % {entries} AS e, i, CAST(floor(sum(x[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM a{n}, range(1, 1 + (SELECT max(len(x)) FROM b0)) r(i) GROUP BY ALL"
            steps.append(f"m{n} AS (SELECT part, e, list(m ORDER BY i) AS x FROM ({sums}) GROUP BY ALL)")
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.e = b.e)")
    steps.append(f"c AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(hex(de % {entries}), 2, '0')), '' ORDER BY part) AS code, CAST(sum(de // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    books = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM c"


#: The others can't be had from SQL: hashes of spans, models, tokenizers, containers and iterations of unknown number. See tests/llm.
ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _codes_sql()}
