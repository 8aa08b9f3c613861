"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

1. Each task hashes the windows of a chunk of documents. Of equal windows in a chunk only the earliest goes on, the
   others are already known to repeat; so a passage in a third of all rows costs one entry a chunk.
2. The window hashes are dealt by bucket. A bucket finds each hash's earliest (document, start); later ones repeat.
3. Repeated windows come back to their document, merge into maximal intervals, and the words in them go.

A window is identified by two independent polynomial hashes: 64 bits, and the bits that chose its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestar.llm.common import mix64, raw, slices

WIDTH = 20
#: Text bytes that a task hashes at once, and that a bucket gets windows of.
CHUNK_BYTES, BUCKET_BYTES, FEWEST_BUCKETS = 4 << 20, 24 << 20, 64
#: Stands for a null doc_id: earlier than all others.
NO_ID = -(1 << 63)
#: Odd bases of the two polynomials, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(max(n, 1), b, np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        _powers[base] = tuple(made)
    up, down = _powers[base]
    return up[:n], down[:n]


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash of the window at each position, over differences of prefix sums."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * down[: n - width + 1])


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def pack(values: np.ndarray) -> bytes:
    """Small differences of an ordered column, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values, prepend=values[:1] * 0).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind), dtype=kind)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


BLOCK = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("ties", pa.binary()), ("starts", pa.binary()), ("gone", pa.binary())])


def window_blocks(ids: np.ndarray, ties: np.ndarray, texts: list[bytes], width: int, buckets: int) -> pa.RecordBatch | None:
    """One row for each bucket: hashes of the chunk's windows, their documents and starts; and the runs of starts that repeat
    in the chunk. Rows with equal id and tie are one document."""
    order = np.lexsort((ties, ids))
    ids, ties = ids[order], ties[order]
    number = np.cumsum((np.diff(ids, prepend=ids[:1]) != 0) | (np.diff(ties, prepend=ties[:1]) != 0))
    hashed = [word_hashes(texts[k]) for k in order]
    sizes = np.fromiter(map(len, hashed), np.int64, len(hashed))
    offsets = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(ids)), counts)
    if not len(doc):
        return None
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    words = np.concatenate(hashed)
    at = offsets[doc] + start
    h = rolling(words, width, BASES[0])[at]
    bucket = (rolling(words, width, BASES[1])[at] % np.uint64(buckets)).astype(np.int32)
    by = np.lexsort((start, number[doc], h))
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (bucket[by][1:] != bucket[by][:-1])
    first = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    repeats = np.zeros(len(by), bool)
    repeats[by] = (number[doc[by]] != number[doc[first]]) | (start[by] != start[first])
    gone_first, gone_last = [], []
    flags = np.concatenate([repeats, [False]])
    a, b = runs(flags[:-1])
    # a run may cross from one document to the next: cut it there
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    inner = cuts[np.searchsorted(a, cuts, "right") > np.searchsorted(b, cuts, "left")]
    inner = np.setdiff1d(inner, a)
    gone_first, gone_last = np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([b, inner - 1]))
    gone_bucket = doc[gone_first] % buckets
    go = np.flatnonzero(~repeats)
    go = go[np.argsort(bucket[go], kind="stable")]
    ends = np.searchsorted(bucket[go], np.arange(buckets + 1))
    out: list[list] = [[] for _ in BLOCK]
    for k in range(buckets):
        own, runs_of = go[ends[k] : ends[k + 1]], np.flatnonzero(gone_bucket == k) if len(gone_first) else gone_first
        if not len(own) and not len(runs_of):
            continue
        of = doc[gone_first[runs_of]]
        gone = np.stack([ids[of], ties[of], start[gone_first[runs_of]], start[gone_last[runs_of]]]) if len(runs_of) else np.zeros((4, 0), np.int64)
        for column, value in zip(out, (k, h[own].tobytes(), pack(ids[doc[own]]), pack(ties[doc[own]]), pack(start[own].astype(np.int32)), gone.astype(np.int64).tobytes())):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, BLOCK)], schema=BLOCK)


SPANS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))])


def spans_by_doc(doc: np.ndarray, tie: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
    """A row for each document with its runs of repeated starts."""
    order = np.lexsort((first, tie, doc))
    doc, tie, first, last = doc[order], tie[order], first[order].astype(np.int32), last[order].astype(np.int32)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    heads = np.flatnonzero(new)
    offsets = pa.array(np.append(heads, len(doc)).astype(np.int32))
    return pa.Table.from_arrays([pa.array(doc[heads]), pa.array(tie[heads]), pa.ListArray.from_arrays(offsets, pa.array(first)), pa.ListArray.from_arrays(offsets, pa.array(last))], schema=SPANS)


def repeats_of_bucket(blocks: pa.Table) -> pa.Table:
    """Of a bucket's windows, those whose hash starts earlier elsewhere."""
    hashes, docs, ties, starts, gone = (blocks.column(k).to_pylist() for k in ("hashes", "docs", "ties", "starts", "gone"))
    h = np.frombuffer(b"".join(hashes), np.uint64)
    doc, tie = (np.concatenate([unpack(x, np.int64) for x in packed]) for packed in (docs, ties))
    start = np.concatenate([unpack(x, np.int32) for x in starts])
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(h)))
    some = np.repeat(size > 1, size)
    order, group = order[some], np.repeat(np.arange((size > 1).sum()), size[size > 1])
    by = np.lexsort((start[order], tie[order], doc[order], group))
    order, group = order[by], group[by]
    first = order[np.flatnonzero(np.diff(group, prepend=-1))][group] if len(group) else order
    late = order[(doc[order] != doc[first]) | (tie[order] != tie[first]) | (start[order] != start[first])]
    known = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in gone], axis=1)
    return spans_by_doc(*(np.concatenate([x, y]) for x, y in zip((doc[late], tie[late], start[late], start[late]), known)))


def cover(n_words: int, firsts: list, lasts: list, width: int) -> np.ndarray:
    """Which words lie in a repeated window: the union of the removal intervals."""
    edges = np.zeros(n_words + width + 1, np.int64)
    if len(firsts):
        first, last = np.asarray(firsts, np.int64), np.asarray(lasts, np.int64) + width
        inside = first < n_words
        np.add.at(edges, first[inside], 1)
        np.add.at(edges, np.minimum(last[inside], n_words), -1)
    return np.cumsum(edges[:n_words]) > 0


def substring_dedup(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, keep_text: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, intervals (removed words, as [from, to)), and kept_text if asked for.

    Null text: no words. Fewer than `width` words: nothing is removed. A null doc_id counts as earlier than all others.
    Rows that repeat a doc_id with one text are one document: a window never makes its own repeated row go. Rows that repeat
    it with unlike texts (null doc_ids too) are documents of their own, in the order of their texts' hashes. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), raw("text").alias("text"))
    # the texts' hashes go along only where doc_ids repeat: elsewhere they would tell nothing, for a tenth more to shuffle
    repeated_ids = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    rows = rows.withColumn("tie", F.xxhash64("text") if repeated_ids else F.lit(0).cast("long"))
    # the only statistic needed beforehand: how many buckets keep a bucket's windows in one task's memory
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(FEWEST_BUCKETS, -(-size // bucket_bytes))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", chunk_bytes):
                made = window_blocks(np.asarray(batch.column("doc"), np.int64), np.asarray(batch.column("tie"), np.int64), batch.column("text").to_pylist(), width, buckets)
                if made is not None:
                    yield made

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", chunk_bytes):
                out: list[list] = [[] for _ in schema]
                for doc_id, text, firsts, lasts in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "firsts", "lasts"))):
                    words = text.split()
                    covered = cover(len(words), [x for y in firsts or () for x in y], [x for y in lasts or () for x in y], width)
                    a, b = runs(covered)
                    kept = b" ".join([words[k] for k in np.flatnonzero(~covered)] if len(a) else words)
                    row = [doc_id, len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest(), [{"from": int(x), "to": int(y) + 1} for x, y in zip(a, b)]]
                    for column, value in zip(out, [*row, kept.decode("utf-8", "replace")]):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("intervals", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))] + [("kept_text", pa.string())] * keep_text)
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<from:int,to:int>>" + ", kept_text string" * keep_text
    repeated = rows.mapInArrow(blocks, "bucket int, hashes binary, docs binary, ties binary, starts binary, gone binary").groupBy("bucket").applyInArrow(repeats_of_bucket, "doc long, tie long, first array<int>, last array<int>")
    keys = ["doc", "tie"] if repeated_ids else ["doc"]
    by_doc = repeated.groupBy(*keys).agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    return rows.join(by_doc, keys, "left").select("doc_id", "text", "firsts", "lasts").mapInArrow(result, kinds)
