"""Vector code compression: product codes whose nearest entries are found by equal-average search.

Components become integers, so that sums, ties and errors are exact whatever the order of rows. A vector is cut into equal
parts, each with a codebook of its own. By Cauchy and Schwarz two parts of dimension w whose component sums are g apart lie at
a squared distance of g * g / w at least: entries are sorted by their sum, and the search goes outwards from the part's own sum
until g * g / w strictly exceeds the best distance, so that equal distances are still seen and go to the lower index.

A round is one narrow pass whose sums for each task are added up in Spark; what reaches the driver is the codebooks, whose size
parameters fix: entries x dimension numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import joined_totals, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held within this: exact for components up to 2**16, and no vector's sum of squares leaves 64 bits.
LARGEST = 1 << 24
#: Parts that are searched at once; bounds a task's memory.
BLOCK = 1 << 17


@dataclass
class Codebooks:
    """entries: integers by part, entry and position within the part. Empty if no vector can be coded."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), held within LARGEST."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def kept_rows(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: which rows hold finite components only, which of these have `dimension` of them, and the
    latter's integers, one row each."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n = len(vectors)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    finite = np.asarray(vectors.is_valid()) & (bad[ends] == bad[ends - sizes]) if n else np.zeros(0, bool)
    coded = finite & (sizes == dimension) if dimension else np.zeros(n, bool)
    own = flat[np.repeat(coded, sizes)] if n else flat
    return finite, coded, integers(own).reshape(-1, max(1, dimension))


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """parts: n, part, position. The index of each part's nearest entry, its squared distance, and how many distances were
    computed for it."""
    n, p, w = parts.shape
    sums = books.sum(axis=2)
    order = np.argsort(sums, axis=1, kind="stable")
    sums = np.take_along_axis(sums, order, axis=1)
    k = sums.shape[1]
    # a sentinel beyond each end, so far away that its side is never taken
    far = np.int64(1) << 61
    edged = np.concatenate([np.full((p, 1), -far), sums, np.full((p, 1), far)], axis=1)
    flat, total = parts.reshape(-1, w), parts.sum(axis=2).ravel()
    at = np.tile(np.arange(p), n)
    high = np.empty(n * p, np.int64)
    for q in range(p):
        high[q::p] = np.searchsorted(sums[q], total[q::p]) + 1
    low = high - 1
    best, index = np.full(n * p, np.iinfo(np.int64).max), np.full(n * p, k)
    live, looked = np.arange(n * p), 0
    while len(live):
        q, below, above = at[live], total[live] - edged[at[live], low[live]], edged[at[live], high[live]] - total[live]
        down = below <= above
        gap = np.where(down, below, above)
        # beyond 2**60 only the sentinels lie; where a product would leave 64 bits the search goes on
        go = (gap < 1 << 60) & ((best[live] > (1 << 62) // w) | (np.minimum(gap, 1 << 31) ** 2 <= np.minimum(best[live], (1 << 62) // w) * w))
        live, q, down = live[go], q[go], down[go]
        if not len(live):
            break
        entry = order[q, np.where(down, low[live], high[live]) - 1]
        distance = ((flat[live] - books[q, entry]) ** 2).sum(axis=1)
        looked += len(live)
        better = (distance < best[live]) | ((distance == best[live]) & (entry < index[live]))
        best[live[better]], index[live[better]] = distance[better], entry[better]
        low[live[down]] -= 1
        high[live[~down]] += 1
    return index.reshape(n, p), best.reshape(n, p), looked


def _named(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))


def first_vectors(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """The vectors of the smallest ids, ties by the vector itself, null ids last: a top-k list of `entries` rows. They must have
    as many components as the first of them, and that a multiple of `parts`."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.coalesce(finite, F.lit(False)))
    in_order = lambda rows, n: rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(n).collect()
    first = in_order(kept, 1)
    size = len(first[0].vector) if first else 0
    if not size or size % parts:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    rows = in_order(kept.where(F.size("vector") == size), entries)
    return Codebooks(integers(np.array([x.vector for x in rows])).reshape(len(rows), parts, -1).transpose(1, 0, 2))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """vectors: vec_id, vector. Each round gives every part to its nearest entry, and makes every entry the floor of its
    parts' mean; entries without parts stay."""
    books = first_vectors(vectors, parts, entries)
    for _ in range(rounds if books.dimension else 0):
        p, k, w = books.entries.shape

        def sums(batches: Iterator[pa.RecordBatch], own: np.ndarray = books.entries) -> Iterator[pa.RecordBatch]:
            # position w holds counts
            total = np.zeros((p * k, w + 1), np.int64)
            for batch in batches:
                _, _, rows = kept_rows(batch.column("vector"), p * w)
                for a in range(0, len(rows), BLOCK // p):
                    cut = rows[a : a + BLOCK // p].reshape(-1, p, w)
                    index, _, _ = nearest(cut, own)
                    cell = (index + k * np.arange(p)).ravel()
                    for x in range(w):
                        # float64 sums of a block are exact: 2**17 numbers within 2**24
                        total[:, x] += np.bincount(cell, cut[:, :, x].ravel().astype(np.float64), p * k).astype(np.int64)
                    total[:, w] += np.bincount(cell, minlength=p * k)
            used = np.flatnonzero(np.repeat(total[:, w] > 0, w + 1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["slot", "total"])

        found = vectors.select("vector").mapInArrow(sums, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
        total = np.zeros(p * k * (w + 1), np.int64)
        total[found.column("slot").to_numpy()] = found.column("total").to_numpy()
        total = total.reshape(p, k, w + 1)
        means = total[:, :, :w] // np.maximum(1, total[:, :, w:])
        books = Codebooks(np.where(total[:, :, w:] > 0, means, books.entries))
    return books


def encode(vectors: DataFrame, books: Codebooks, carry: str = "vec_id long") -> DataFrame:
    """vectors: the columns of `carry`, and vector. These columns, code and error for each row whose vector is finite; both are
    null where a vector has another number of components than the codebooks. One narrow pass."""
    names = [x.split()[0] for x in carry.split(", ")]

    def run(batches: Iterator[pa.RecordBatch], own: np.ndarray = books.entries, dimension: int = books.dimension) -> Iterator[pa.RecordBatch]:
        p, _, w = own.shape
        step = max(1, BLOCK // p)
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                finite, coded, rows = kept_rows(batch.column("vector"), dimension)
                codes = np.full(len(finite), None, object)
                errors = np.zeros(len(finite), np.int64)
                if len(rows) and dimension:
                    index, distance, _ = nearest(rows.reshape(-1, p, w), own)
                    text = index.astype(np.uint8).tobytes().hex()
                    codes[coded] = [text[i : i + 2 * p] for i in range(0, len(text), 2 * p)]
                    errors[coded] = distance.sum(axis=1)
                stay = pa.array(finite)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).filter(stay) for x in names), pa.array(codes[finite], pa.string()), pa.array(errors[finite], mask=~coded[finite])], names=[*names, "code", "error"])

    return vectors.select(*names, "vector").mapInArrow(run, f"{carry}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with `approximation`: the middle of the steps that each code's entries stand for; null for a null code."""
    p, _, w = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch], own: np.ndarray = books.entries) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else ((own[np.arange(p), list(bytes.fromhex(x))] + 0.5) / SCALE).ravel() for x in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, "approximation"])

    return codes.mapInArrow(run, f"{', '.join(f'`{k}` {v}' for k, v in codes.dtypes)}, approximation array<double>")


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of vectors whose vector is neither null nor holds a null or non-finite component: vec_id, code (two
    hex digits a part), error (squared distances summed over parts), label_error (the error of all rows with that label, nulls
    together), codebooks_sha256.

    The codebooks begin with the vectors of the smallest ids; of rows that repeat an id each counts, null ids come last. Vectors
    of another dimension than the first, empty ones, and all where parts doesn't divide the dimension, have a null code and
    error. An empty table: an empty result. Other columns are ignored. Components beyond 2**16 count as that.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 256 entries")
    books = train(_named(vectors, key, vector), parts, entries, rounds)
    kind = vectors.schema[label].dataType.simpleString()
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    coded = written(encode(rows, books, f"vec_id long, label {kind}"))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return joined_totals(coded, totals, "label").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
