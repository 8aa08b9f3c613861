"""Approximate dense search: inverted lists with product codes, and exact scores for what they bring up.

Unit vectors are dealt to the nearest of some cells; what is left of them is coded part by part, a byte each. A query looks at
its nearest cells, scores their codes, and only the best codes' vectors are fetched and scored exactly, as retrieval.dense does.
All rows are indexed. Cells and codebooks are fitted on FIT_ROWS rows at most, taken by a hash of the key.

How many cells and codes a query needs hangs on the vectors: few if they lie in clusters, most cells if they lie anywhere. So
the index finds it out when it is built: TRIED of its rows, taken by another hash, are searched exactly among all, and their
neighbours' places say how far to look.

Lists are blocks of some thousand codes of several cells and queries are taken some hundred at a time, so that a task's work is
one block of each, whatever a cell holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.layout import stored
from lodestar.operators.retrieval import DEFAULT_K

FIT_ROWS, BOOK_ROWS, FIT_ROUNDS = 20_000, 10_000, 10
#: Parts at most, and codes of each.
PARTS, CODES = 64, 256
#: Vectors in a block, codes in a list's block, and queries that meet it at once.
BLOCK, LIST, TOGETHER = 4096, 16_384, 256
SALTS = 16
#: Rows whose exact neighbours are found when an index is built, and the shares of these neighbours that the probed cells and the
#: best codes have to hold.
TRIED, IN_CELLS, IN_CODES = 200, 0.985, 0.995
#: Cells and codes that a query looks at in any case.
PROBES, CANDIDATES = 8, 32


@dataclass
class Model:
    """cells: unit vectors' cell centres. books: part, code, position. probes, candidates: cells and codes that a query looks
    at. lists: that the cells are dealt to."""

    cells: np.ndarray
    books: np.ndarray
    probes: int = PROBES
    candidates: int = CANDIDATES
    lists: int = 1

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(rows, self.cells)
        rest = (rows - self.cells[cell]).reshape(len(rows), len(self.books), -1)
        return cell, np.stack([nearest(rest[:, p], self.books[p]) for p in range(len(self.books))], axis=1).astype(np.uint8)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.cells[cell] + self.books[np.arange(len(self.books)), codes].reshape(len(cell), -1)

    def bytes_decoded(self, cell: np.ndarray, codes: list[bytes]) -> np.ndarray:
        return self.decoded(cell, np.frombuffer(b"".join(codes), np.uint8).reshape(-1, len(self.books)))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if centres.shape[1] == 1:
        order = np.argsort(centres[:, 0], kind="stable")
        own = centres[order, 0]
        return order[np.searchsorted((own[1:] + own[:-1]) / 2, rows[:, 0])]
    return np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)


def means(rows: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Lloyd's rounds from k different rows at even steps; a centre without rows stays."""
    first = np.sort(np.unique(rows, axis=0, return_index=True)[1]) if rows.shape[1] > 1 else np.unique(rows, return_index=True)[1]
    centres = rows[first[np.linspace(0, len(first) - 1, min(k, len(first))).astype(int)]].copy()
    for _ in range(rounds):
        of = nearest(rows, centres)
        total = np.zeros_like(centres)
        np.add.at(total, of, rows)
        n = np.bincount(of, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def unit(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have this dimension, finite components and a length, and these as unit vectors."""
    ok, rows = np.zeros(len(lists), bool), []
    for k, x in enumerate(lists.to_pylist()):
        if x is not None and len(x) == dimension and None not in x:
            v = np.asarray(x, np.float64)
            length = np.sqrt(v @ v)
            if np.isfinite(length) and length > 0:
                ok[k] = True
                rows.append(v / length)
    return ok, np.array(rows).reshape(-1, dimension)


def fit(vectors: DataFrame, cells: int, parts: int = PARTS) -> Model:
    """vectors: key, vector. As many parts as divide the dimension, up to `parts`."""
    sample = vectors.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).toArrow()
    lists = sample.column("vector").combine_chunks()
    sizes = [len(x) for x in lists.to_pylist()]
    dimension = max(set(sizes), key=sizes.count) if sizes else parts
    _, rows = unit(lists, dimension)
    if not len(rows):
        return Model(np.zeros((1, dimension)), np.zeros((1, 1, dimension)))
    parts = max(x for x in range(1, parts + 1) if dimension % x == 0)
    centres = means(rows, cells)
    rest = (rows - centres[nearest(rows, centres)]).reshape(len(rows), parts, -1)[:BOOK_ROWS]
    books = [means(rest[:, p], CODES) for p in range(parts)]
    # a part with fewer different values than CODES repeats its last entry
    return Model(centres, np.stack([np.concatenate([x, np.repeat(x[-1:], max(map(len, books)) - len(x), axis=0)]) for x in books]))


def lists_of(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def needed(places: np.ndarray, share: float) -> int:
    """How many places, from the first on, hold this share of those given."""
    return int(np.sort(places)[int(np.ceil(share * len(places))) - 1]) + 1


def settled(named: DataFrame, coded: DataFrame, model: Model, k: int = DEFAULT_K) -> Model:
    """The model with the cells and codes that TRIED rows need to find their k neighbours among all other rows."""
    dimension = model.cells.shape[1]
    tried = named.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("key", F.lit(1)), "key").limit(TRIED).toArrow()
    ok, asked = unit(tried.column("vector").combine_chunks(), dimension)
    own = tried.column("key").to_numpy()[ok]
    if not len(asked):
        return model

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(a, BLOCK)
                ok, rows = unit(batch.column("vector"), dimension)
                if len(rows):
                    keys = batch.column("key").to_numpy()[ok]
                    order = np.argsort(keys, kind="stable")
                    total = np.where(own[:, None] == keys[order], -np.inf, np.round(asked @ rows[order].T, 12))
                    q, at = np.nonzero(_tops(total, k) & (total > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(keys[order][at]), pa.array(total[q, at])], names=["query", "key", "score"])

    # at most TRIED * k rows
    near = best(named.mapInArrow(exact, "query long, key long, score double"), k)
    wanted = coded.join(F.broadcast(near), "key").select("query", "cell", "code").toArrow()
    if not wanted.num_rows:
        return model
    query, cell = wanted.column("query").to_numpy(), wanted.column("cell").to_numpy()
    order = np.argsort(-asked @ model.cells.T, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    least = (asked[query] * model.bytes_decoded(cell, wanted.column("code").to_pylist())).sum(1) + 1e-9
    probes = max(PROBES, needed(place[query, cell], IN_CELLS))

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(query), np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(a, BLOCK)
                cells = batch.column("cell").to_numpy()
                total = np.where(place[:, cells] < probes, asked @ model.bytes_decoded(cells, batch.column("code").to_pylist()).T, -np.inf)
                total.sort(axis=1)
                n += [total.shape[1] - np.searchsorted(total[q], x, "right") for q, x in zip(query, least)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["k", "n"])

    better = coded.mapInArrow(above, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return replace(model, probes=probes, candidates=max(CANDIDATES, needed(better.column("n").to_numpy(), IN_CODES)))


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> Model:
    """Writes blocks of keys, cells and codes, and the vectors by key, to path. Null and zero vectors and those of another
    dimension than most have no direction, and are in no list; neither are rows without a key."""
    named = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    named.write.mode("overwrite").parquet(f"{path}/vectors")
    named = vectors.sparkSession.read.schema(named.schema).parquet(f"{path}/vectors")
    n = named.count()
    model = fit(named, cells or int(np.clip(np.sqrt(n), 16, 4096)))
    dimension = model.cells.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(a, BLOCK)
                ok, rows = unit(batch.column("vector"), dimension)
                if len(rows):
                    cell, codes = model.codes(rows)
                    yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(ok)), pa.array(cell, pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary())], names=["key", "cell", "code"])

    coded = stored(named.mapInArrow(run, "key long, cell int, code binary"))
    model = settled(named, coded, model)
    # cells share a list, and a list that is too long is cut by key
    listed = coded.withColumn("list", F.col("cell") % lists_for(n))
    shares = listed.groupBy("list").agg(F.ceil(F.count("*") / LIST).alias("shares"))
    share = F.pmod(F.xxhash64("key"), F.col("shares"))
    blocks = listed.join(F.broadcast(shares), "list").groupBy("list", share.alias("share")).agg(F.sort_array(F.collect_list(F.struct("key", "cell", "code"))).alias("x"))
    blocks.select("list", F.col("x.key").alias("keys"), F.col("x.cell").alias("cells"), F.col("x.code").alias("codes")).write.mode("overwrite").parquet(f"{path}/blocks")
    return replace(model, lists=lists_for(n))


def lists_for(n: int) -> int:
    return max(1, -(-n // LIST))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm(a) > 0) & (norm(b) > 0) & (F.size(a) == F.size(b)), dot / (norm(a) * norm(b)))


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query (query, key, score) with their rank, ties by key; cut in parts before a query's meet in one task."""
    cut = lambda x, *of: x.withColumn("rank", F.row_number().over(Window.partitionBy("query", *of).orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    return cut(cut(rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))), "salt").drop("salt", "rank"))


def _tops(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k highest scores; of equal ones the first. Columns are in the order of their keys."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    last = np.partition(scores, -k, axis=1)[:, -k : -k + 1 or None]
    above, equal = scores > last, scores == last
    return above | equal & (equal.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True))


def search(spark: SparkSession, path: str, model: Model, queries: DataFrame, k: int = DEFAULT_K, probes: int | None = None, candidates: int | None = None) -> DataFrame:
    """queries: query, vector. query, key, score, rank: of the best codes in each query's nearest cells the k best by exact cosine.
    Without probes and candidates the index's own hold, more codes for a larger k."""
    dimension, many = model.cells.shape[1], model.lists
    probes, candidates = probes or model.probes, candidates or model.candidates * max(1, -(-k // DEFAULT_K))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, rows = unit(batch.column("vector"), dimension)
            if len(rows):
                cells = np.argsort(-rows @ model.cells.T, axis=1, kind="stable")[:, :probes].astype(np.int32)
                keys = batch.column("query").to_numpy()[ok]
                own = [(q, of, x[x % many == of]) for q, x in enumerate(cells) for of in np.unique(x % many)]
                yield pa.RecordBatch.from_arrays([pa.array([keys[q] for q, _, _ in own], pa.int64()), lists_of(rows[[q for q, _, _ in own]]), pa.array([of for _, of, _ in own], pa.int32()), pa.array([x for _, _, x in own], pa.list_(pa.int32()))], names=["query", "vector", "list", "probed"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, keys, cells, codes = (batch.column(x)[k].values for x in ("asked", "keys", "cells", "codes"))
                query, vectors, cells = asked.field("query").to_numpy(), np.array(asked.field("vector").to_pylist()), cells.to_numpy()
                probed = np.zeros((len(query), len(model.cells)), bool)
                for q, x in enumerate(asked.field("probed").to_pylist()):
                    probed[q, x] = True
                opened = np.flatnonzero(probed.any(axis=0)[cells])
                total = vectors @ model.bytes_decoded(cells[opened], codes.take(pa.array(opened)).to_pylist()).T
                # equal codes get equal scores, wherever they stand
                total = np.where(probed[:, cells[opened]], np.round(total, 9), -np.inf)
                q, at = np.nonzero(_tops(total, candidates) & (total > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(query[q]), pa.array(keys.to_numpy()[opened[at]]), pa.array(total[q, at])], names=["query", "key", "score"])

    named = queries.where("query is not null").select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<double>").alias("vector"))
    groups = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-named.count() // TOGETHER))))
    asked = named.mapInArrow(near, "query long, vector array<double>, list int, probed array<int>").groupBy("list", groups.alias("group")).agg(F.collect_list(F.struct("query", "vector", "probed")).alias("asked"))
    found = asked.join(spark.read.parquet(f"{path}/blocks"), "list").select("keys", "cells", "codes", "asked").mapInArrow(scored, "query long, key long, score double")
    chosen = best(found, candidates).select("query", "key")
    met = chosen.join(spark.read.parquet(f"{path}/vectors"), "key").join(named.withColumnRenamed("vector", "asked"), "query")
    return best(met.select("query", "key", cosine(F.col("asked"), F.col("vector")).alias("score")).where("score is not null"), k)


def exhaustive(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """vectors: key, vector. queries: query, vector. query, key, score, rank by exact cosine: a stated set of queries against all
    rows, in blocks of both. Scores are rounded to 12 places, so that equal vectors have equal ones."""
    chunk = lambda rows, key, size: rows.groupBy(F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // size))))).agg(F.sort_array(F.collect_list(F.struct(F.col(key).cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector")))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sides: list[dict[int, list]] = []
                for name in ("asked", "rows"):
                    of_size: dict[int, list] = {}
                    for x in row[name]:
                        if x["vector"] and None not in x["vector"]:
                            of_size.setdefault(len(x["vector"]), []).append(x)
                    sides.append(of_size)
                # vectors of unlike sizes have no angle
                for size in sides[0].keys() & sides[1].keys():
                    (asked, a), (keys, b) = ((np.array([x["key"] for x in own[size]], np.int64), np.array([x["vector"] for x in own[size]])) for own in sides)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        total = (a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))
                    total = np.where(np.isfinite(total), np.round(total, 12), -np.inf)
                    q, at = np.nonzero(_tops(total, k) & (total > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(keys[at]), pa.array(total[q, at])], names=["query", "key", "score"])

    pairs = chunk(queries, "query", TOGETHER).withColumnRenamed("x", "asked").select("asked").crossJoin(chunk(vectors, "key", BLOCK).withColumnRenamed("x", "rows").select("rows"))
    return best(pairs.mapInArrow(run, "query long, key long, score double"), k)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """queries, wanted, met: how many of the wanted (query, key) rows were found."""
    both = wanted.join(found.select("query", "key", F.lit(True).alias("hit")), ["query", "key"], "left")
    return both.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("met"))
