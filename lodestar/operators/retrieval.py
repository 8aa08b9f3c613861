"""Retrieval: BM25, dense search, rank fusion, and results within a byte budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.stems import stem, stems
from lodestar.functions.text import byte_length, tokens

# Robertson and Zaragoza 2009; Cormack et al. 2009.
K1, B, RRF = 1.2, 0.75, 60
DEFAULT_K, MOST_K, HARD_K = 12, 40, 100
BUDGET = 40_000


def clamp_k(k: int = DEFAULT_K, hard: bool = False) -> int:
    return max(0, min(k, HARD_K if hard else MOST_K))


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", stemmed: bool = False) -> DataFrame:
    """key, score of each document with a term. Only the query's terms are counted, in one pass; statistics cover all rows.

    Texts are read and split once: what goes on is a few numbers a row, dealt out by key, and both the statistics and the
    scores are made from that one exchange. The array passes a generator so that no later step splits a text again. stemmed:
    forms of one word, English or Russian, count as one term.
    """
    terms = list(dict.fromkeys(stem(x.lower()) if stemmed else x.lower() for x in terms))
    count = lambda term: F.size("__t") - F.size(F.array_remove("__t", term))
    split = docs.select(key, F.explode(F.array(stems(tokens(text)) if stemmed else tokens(text))).alias("__t"))
    counted = split.select(key, F.size("__t").alias("length"), *(count(t).alias(f"tf{k}") for k, t in enumerate(terms))).repartition(key)
    n = counted.agg(F.count("*").alias("n"), F.avg("length").alias("average"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))))
    # the statistics are one row
    scored = counted.join(F.broadcast(n), F.lit(True))
    score: Column = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("average")))).otherwise(0.0)
    # a document without a term scores 0, one with any scores more
    return scored.select(key, score.alias("score")).where("score > 0")


def dense(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, score: exact cosine with one query vector. Null or zero vectors, and those of another length, score null."""
    length = math.sqrt(sum(x * x for x in query))
    # products by position; the query is a literal, so this is one narrow projection
    dot = F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select(key, F.when((norm > 0) & F.lit(length > 0) & (F.size(vector) == len(query)), dot / (norm * length)).alias("score"))


def top_k(scored: DataFrame, k: int = DEFAULT_K, key: str = "doc_id", hard: bool = False) -> DataFrame:
    """The best k by score, ties by key; k is clamped. TakeOrderedAndProject: no full sort."""
    return scored.where("score is not null").orderBy(F.desc("score"), key).limit(clamp_k(k, hard))


def ranked(top: DataFrame, key: str = "doc_id") -> DataFrame:
    """A top-k list with ranks from 1; it has at most HARD_K rows."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(lists: dict[str, DataFrame], key: str = "doc_id", constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of rank lists (key, rank): key, score, and each list's rank (null where it isn't in it)."""
    out = None
    for name, df in lists.items():
        own = df.select(key, F.col("rank").alias(f"{name}_rank"))
        out = own if out is None else out.join(own, key, "full_outer")
    parts = [F.coalesce(1.0 / (constant + F.col(f"{name}_rank")), F.lit(0.0)) for name in lists]
    return out.select(key, sum(parts, F.lit(0.0)).alias("score"), *(f"{name}_rank" for name in lists))


def within_budget(results: DataFrame, order: list[str], text: str = "text", budget: int = BUDGET) -> DataFrame:
    """results with rank, n_bytes, used and is_full. In rank order texts are full while their bytes' sum fits; rank 1 always
    is. A closed prefix stays closed: later ones are header-only locators (null text). Results are a top-k list."""
    by = Window.orderBy(*order)
    summed = results.withColumn("n_bytes", byte_length(text)).withColumn("rank", F.row_number().over(by)).withColumn("used", F.sum("n_bytes").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    full = (F.col("rank") == 1) | (F.col("used") <= budget)
    return summed.withColumn("is_full", full).withColumn(text, F.when(full, F.col(text)))


def search(chunks: DataFrame, terms: list[str] | None = None, query: list[float] | None = None, mode: str = "hybrid", k: int = DEFAULT_K, min_score: float | None = None, section_path_prefix: str | None = None, budget: int = BUDGET, verbosity: str = "lean", key: str = "chunk_id", candidates: int = HARD_K, stemmed: bool = False) -> DataFrame:
    """Chunks by `mode` (hybrid, bm25, dense), filtered, cut to k and to the byte budget. full adds the score's components.

    A score counts all chunks, whatever the filter leaves. stemmed: words match in all their forms.
    """
    pool = chunks.where(F.col("section_path").startswith(section_path_prefix)) if section_path_prefix else chunks
    within = lambda scored: scored.join(pool.select(key), key, "left_semi") if section_path_prefix else scored
    lists = {}
    if mode in ("hybrid", "dense") and query:
        lists["dense"] = top_k(dense(pool, query, key), candidates, key, hard=True)
    if mode in ("hybrid", "bm25") and terms:
        lists["bm25"] = top_k(within(bm25(chunks, terms, key, stemmed=stemmed)), candidates, key, hard=True)
    if not lists:
        raise ValueError(f"{mode} needs terms or a query vector")
    scored = fuse({name: ranked(df, key) for name, df in lists.items()}, key) if mode == "hybrid" else next(iter(lists.values()))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    best = top_k(scored, k, key)
    # at most HARD_K rows: small by construction
    rows = pool.join(F.broadcast(best), key)
    out = within_budget(rows.withColumn("__minus", -F.col("score")), ["__minus", key], "text", budget).drop("__minus")
    return out if verbosity == "full" else out.drop(*(x for x in ("dense_rank", "bm25_rank", "extra", "embedding") if x in out.columns))
