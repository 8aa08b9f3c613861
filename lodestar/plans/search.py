"""Registered queries over search indexes: a table of queries at once, beside exhaustive scores in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.cuts import cut_texts
from lodestar.functions.layout import shared_folder
from lodestar.functions.text import tokens
from lodestar.operators import postings as PI
from lodestar.operators import retrieval as R
from lodestar.operators import vectors as V
from lodestar.plans.catalog import _BM25, _DENSE, TERMS, query_vector, registered, table, texts

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SCORES = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(w)) AS average FROM d),
    tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    b AS (SELECT item_id AS query, {_WORDS}[1:4] AS w FROM benchmark), q AS (SELECT query, term, min(pos) AS pos FROM (SELECT query, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM b) GROUP BY ALL),
    scored AS (SELECT query, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) ORDER BY pos) AS score FROM q JOIN df USING (term) JOIN tf USING (term), s GROUP BY ALL)"""


def four_words(spark, sf_dir):
    """Queries: the first four words of each benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.slice(tokens("text"), 1, 4).alias("terms"))


@registered(f"WITH {_SCORES} SELECT query, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 12")
def postings_search(spark, sf_dir):
    """The best documents of many queries, from an index whose weak terms and blocks aren't opened."""
    index = shared_folder(spark)
    PI.build(texts(spark, sf_dir), index)
    return PI.search(spark, index, four_words(spark, sf_dir)).select("query", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@registered("SELECT count(*) AS queries, CAST(12 * count(*) AS BIGINT) AS wanted, true AS good FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark, sf_dir):
    """Approximate neighbours of every fiftieth vector against exact ones among all: at least 0.95 of them are found."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    queries = rows.where("key % 50 = 0").withColumnRenamed("key", "query")
    index = shared_folder(spark)
    model = V.build(rows, index, "key", "vector")
    met = V.recall(V.search(spark, index, model, queries), V.exhaustive(rows, queries))
    return met.select("queries", "wanted", (F.col("met") >= 0.95 * F.col("wanted")).alias("good"))


_FORMS = ["CASE WHEN c_custkey % 3 = 0 THEN 'The agent called about shipping' WHEN c_custkey % 3 = 1 THEN 'agents calling, and calling again' ELSE 'nothing was national' END", "c_mktsegment"]


@registered(f"""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 2 ELSE 0 END AS a, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS b, CASE WHEN c_custkey % 3 = 2 THEN 4 ELSE 6 END AS length FROM customer),
    s AS (SELECT count(*) AS n, avg(length) AS average, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM d)
    SELECT c_custkey, round(CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / average)) ELSE 0 END
      + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / average)) ELSE 0 END, 6) AS score FROM d, s WHERE a > 0 OR b > 0""")
def stemmed_search(spark, sf_dir):
    """Forms of a word meet: calls finds called and calling, ships finds shipping."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"concat_ws(' ', {', '.join(_FORMS)})").alias("text"))
    return R.bm25(rows, ["Calls", "ships"], "c_custkey", stemmed=True).select("c_custkey", F.round("score", 6).alias("score"))


@registered("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS joined, true AS bounded, octet_length(encode(text)) > 2000 AS is_cut FROM documents WHERE text IS NOT NULL")
def bounded_chunks(spark, sf_dir):
    """Texts cut by their content into parts of 2,000 bytes at most, which join to the text again."""
    parts = F.col("parts")
    rows = texts(spark, sf_dir).select("doc_id", F.explode(F.array(cut_texts(F.col("text"), 2000))).alias("parts")).withColumn("whole", F.array_join(F.transform(parts, lambda x: x["text"]), ""))
    bounded = F.forall(parts, lambda x: F.octet_length(x["text"]) <= 2000)
    return rows.select("doc_id", F.octet_length("whole").cast("long").alias("n_bytes"), F.md5("whole").alias("joined"), bounded.alias("bounded"), (F.size("parts") > 1).alias("is_cut"))


@registered(f"""WITH {_BM25}, {_DENSE}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 100), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM dense WHERE vec_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL) QUALIFY rank <= 100),
    f AS (SELECT doc_id, coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0) AS score, a.rank AS bm25_rank, b.rank AS dense_rank FROM a FULL JOIN b USING (doc_id)),
    k AS (SELECT f.*, octet_length(encode(text)) AS n_bytes, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f JOIN documents USING (doc_id) QUALIFY rank <= 12)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, round(score, 8) AS score, CAST(bm25_rank AS INTEGER) AS bm25_rank, CAST(dense_rank AS INTEGER) AS dense_rank, n_bytes > 0 AS has_text FROM k""")
def search_hybrid(spark, sf_dir):
    """A hybrid search with its score's components: two rank lists fused, cut to k and to the byte budget."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = texts(spark, sf_dir).join(vectors, "doc_id", "left").withColumn("section_path", F.lit(""))
    found = R.search(chunks, TERMS, query_vector(spark, sf_dir), k=12, verbosity="full", key="doc_id")
    return found.select("doc_id", "rank", F.round("score", 8).alias("score"), "bm25_rank", "dense_rank", (F.col("n_bytes") > 0).alias("has_text"))
