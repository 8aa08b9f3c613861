"""SimHash near-dedup by multi-index hashing.

Fingerprints of 64 bits are cut in two segments of 32. Two that differ in at most two bits are equal in the low segment,
or differ in at most one bit of the high segment. So each distinct fingerprint looks up the Hamming ball of radius one
around its high segment and its low segment itself, and complete distances are verified. A segment value that very many
fingerprints share is not expanded to pairs: there the ball in the other segment is enumerated too, up to the distance
that is left, and whole fingerprints are looked up, which bounds the work for each fingerprint.

simhash_groups links at a Hamming distance; simhash_dedup, for filtering, at a similarity of word shingles. It groups texts
by their fingerprints first: pairs from the same lookups, each checked exactly, and their components. Fingerprints miss pairs
at that similarity, so texts that are still apart meet by prefixes of their shingle sets: two sets that are alike enough share
a shingle of their prefixes, at every number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from xxhash import xxh64_intdigest, xxh128_digest

from lodestar.llm.common import emptied, mix64, new_path, raw, slices, written
from lodestar.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Beyond so many distinct fingerprints with one segment value, whole fingerprints are looked up instead.
HOT_BUCKET = 512
SEGMENT_BITS = 32


#: Hashes whose bits are counted at once; bounds the memory of one very long text.
BLOCK = 1 << 16


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of some hashes have each bit, the highest first."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), BLOCK):
        total += np.unpackbits(hashes[a : a + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    ends = (starts + sizes - 1)[width - 1 :]
    total = np.zeros(64, np.int64)
    for k in range(0, len(ends), BLOCK):
        total += ones(np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())], np.uint64))
    return int.from_bytes(np.packbits(2 * total > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64 bits) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                fps = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS)


def low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def masks(radius: int) -> list[int]:
    """All masks of at most radius bits of a segment."""
    return [sum(1 << k for k in bits) for r in range(radius + 1) for bits in combinations(range(SEGMENT_BITS), r)]


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """fps: fp, distinct. Pairs a < b of fingerprints at distance one or two."""
    f = F.col("fp")
    index = fps.select(F.explode(F.array(F.struct(F.lit(0).alias("seg"), high(f).alias("key")), F.struct(F.lit(1).alias("seg"), low(f).alias("key")))).alias("x"), "fp").select("x.*", "fp")
    counts = written(index.groupBy("seg", "key").count().where(F.col("count") > hot_bucket).select("seg", "key"))
    # a bit of the ball is only ever set, never cleared: of two neighbours in the high segment one finds the other
    ball = F.filter(F.array(*(F.lit(1 << k).cast("long") for k in range(SEGMENT_BITS))), lambda m: high(f).bitwiseAND(m) == 0)
    probe = F.concat(
        F.array(F.struct(F.lit(0).alias("seg"), high(f).alias("key"), F.lit(2).alias("left")), F.struct(F.lit(1).alias("seg"), low(f).alias("key"), F.lit(2).alias("left"))),
        F.transform(ball, lambda m: F.struct(F.lit(0).alias("seg"), high(f).bitwiseOR(m).alias("key"), F.lit(1).alias("left"))),
    )
    probes = fps.select(F.explode(probe).alias("x"), "fp").select("x.*", "fp")
    pair = [F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")]
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).between(1, DISTANCE)
    cool = index.join(counts, ["seg", "key"], "left_anti").withColumnRenamed("fp", "other")
    found = probes.join(cool, ["seg", "key"]).where(((F.col("left") == 1) | (F.col("fp") < F.col("other"))) & near).select(*pair)
    # the exact way for the rest: each probe of a hot bucket becomes whole fingerprints
    mask = F.when(F.col("left") == 2, F.array(*(F.lit(m).cast("long") for m in masks(2)))).otherwise(F.array(*(F.lit(m).cast("long") for m in masks(1))))
    hot = probes.join(counts, ["seg", "key"], "left_semi").withColumn("mask", F.explode(mask))
    whole = F.when(F.col("seg") == 0, F.shiftleft("key", SEGMENT_BITS).bitwiseOR(low(f).bitwiseXOR(F.col("mask")))).otherwise(F.shiftleft(high(f).bitwiseXOR(F.col("mask")), SEGMENT_BITS).bitwiseOR(F.col("key")))
    rest = hot.select("fp", whole.alias("other")).join(fps.select(F.col("fp").alias("other")), "other").where(near).select(*pair)
    return found.union(rest).distinct()


def simhash_groups(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, n_links.

    n_links: other distinct fingerprints that the row's fingerprint links to. Null or empty text: fingerprint zero, linked
    like any other. component_id is the smallest doc_id reachable; null doc_ids are reachable but never smallest, so a
    component of these alone has null. Repeated rows share one fingerprint and component. An empty table: an empty result.
    """
    rows = written(fingerprints(docs))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = written(links(classes.select("fp"), hot_bucket))
    roots = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    of_class = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    table = of_class.join(least, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


# ---- near duplicates by similarity: linked fingerprints, then prefixes of the shingle sets, and an exact check behind both

#: Word shingles and their Jaccard similarity from which two texts are near duplicates.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Shingles that a sample of one in SAMPLE texts has OFTEN times are put last in the order, MOST_OFTEN of them at most. Any
#: order finds all pairs; one with rare shingles first finds few others.
SAMPLE, OFTEN, MOST_OFTEN = 4, 3, 1 << 20
#: Bits of a parity sketch for each shingle, and at least: two differ in no more bits than their sets differ in shingles.
PARITY_RATE, LEAST_PARITY = 2.5, 256
#: From round to round a shingle has so many times more holders.
SALTS = 8
#: Hashes fall on so many slots. A table of slots has no more rows, whatever its input, so it may be broadcast.
SLOTS = 1 << 20


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes, width: int = NEAR_SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, hashed; a shorter text is one shingle."""
    h = _word_hashes(text.lower().split())
    if len(h) <= width:
        width = len(h)
    if not width:
        return np.zeros(1, np.int64)
    own = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        own = mix64(own ^ h[k : k + len(own)]) + np.uint64(k)
    return np.unique(own).view(np.int64)


def prefix(own: np.ndarray, similarity: float, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in an order that all sets share: those not in `often` (sorted) first, then by their counts.

    Two sets of m and n shingles that are `similarity` alike share similarity * max(m, n) at least. The first of these in the
    order has fewer than m - similarity * m others of its own set before it, so it is in both prefixes.
    """
    rank = np.zeros(len(own), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        rank = np.where(often[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))][: len(own) - max(1, math.ceil(similarity * len(own) - 1e-6)) + 1]


def parity(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit, as 64-bit numbers. A power of two of bits, so that the sketch of a
    larger set folds to the width of a smaller one's."""
    bits = max(LEAST_PARITY, 1 << math.ceil(math.log2(PARITY_RATE * len(own))))
    return np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def folded(bits: Column, width: Column) -> Column:
    """A sketch at half its width, where it is wider than `width` numbers."""
    half = F.zip_with(F.slice(bits, F.lit(1), width), F.slice(bits, width + 1, width), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > width, half).otherwise(bits)


def text_key(text: bytes) -> bytes:
    """Equal for texts of the same words, but for case and white space."""
    return xxh128_digest(b" ".join(text.lower().split()))


def often_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many texts, sorted, and their counts in a sample."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                owns = [shingle_set(x, width) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owns))], names=["token"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(sets, "token long")
    found = sample.groupBy("token").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(MOST_OFTEN).toArrow()
    tokens, counts = found.column("token").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def least_shared(similarity: float, sizes: Column) -> Column:
    """Shingles that two sets share at least, if they are `similarity` alike and have `sizes` together."""
    return similarity / (1 + similarity) * sizes - 1e-6


def indexed(similarity: float) -> Column:
    """Whether a shingle (pos in the order of its set of size) can be the first that a set shares with one of its own size or
    a larger one. What lies behind it must hold all that they share, so the smaller set is found by fewer shingles."""
    return F.col("size") - F.col("pos") >= least_shared(similarity, 2 * F.col("size"))


def can_meet(similarity: float) -> Column:
    """Whether a shingle (size, pos) may be the first that its set shares with the one of `holder` (size, pos): the holder's is
    the smaller set, large enough, and both have enough shingles from here on. No pair that is alike goes: its first common
    shingle passes."""
    size, pos, own, at = F.col("size"), F.col("pos"), F.col("holder.size"), F.col("holder.pos")
    return (own <= size) & (own >= similarity * size - 1e-6) & (F.least(size - pos, own - at) >= least_shared(similarity, size + own))


def first_holders(nodes: DataFrame, similarity: float) -> DataFrame:
    """nodes: node, size, prefix. token, node, size, pos, holder, several for each shingle of two prefixes or more that a set is
    indexed by; holder is the smallest such set (size, pos, node), several tells whether there are more."""
    index = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "token"))
    ends = index.where(indexed(similarity)).groupBy("token").agg(F.min(F.struct("size", "pos", "node")).alias("holder"), F.count("*").alias("n"))
    met = index.join(ends, "token").where("node != holder.node or n > 1")
    return met.select("token", "node", "size", "pos", "holder", (F.col("n") > 1).alias("several"))


def ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("node", "holder.node").alias("a"), F.greatest("node", "holder.node").alias("b")).distinct()


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of pairs a, b whose sizes are alike, those whose parity sketches don't rule out that they are; no such pair goes."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("bits").alias(f"bits_{name}"))
    # such sizes differ by a quarter at most, so that of their sketches one is twice as wide at most
    width = F.least(F.size("bits_a"), F.size("bits_b"))
    differ = F.aggregate(F.zip_with(folded(F.col("bits_a"), width), folded(F.col("bits_b"), width), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = (1 - similarity) / (1 + similarity) * (F.col("size_a") + F.col("size_b")) + 1e-6
    return pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= most).select("a", "b")


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """nodes: node, fp. Pairs a < b that fingerprints propose: each node with the least one of its fingerprint, and that one with
    the least one of all fingerprints that its own links to. No more than two pairs a node, however many fingerprints link."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(least, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = written(links(least.select("fp")))
    both = pairs.union(pairs.select("b", "a")).toDF("fp", "other")
    first = both.join(least.toDF("other", "holder"), "other").groupBy("fp").agg(F.min("holder").alias("holder")).join(least, "fp")
    return same.union(first.select(F.least("least", "holder"), F.greatest("least", "holder")).distinct())


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs a, b that aren't of one root yet. roots: node, root for each node that has a link."""
    side = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    known = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return known.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def on_slots(rows: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """The rows whose number in `column` falls on a slot of one in `of`: all that join with it, and few others as long as `of`
    is small beside SLOTS. A join behind this moves only these."""
    slot = F.pmod(F.col(column), F.lit(SLOTS))
    return rows.join(F.broadcast(of.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")


def near_classes(docs: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key for each row of docs; and key, least, root for each class of texts of equal words: its smallest doc_id, and
    a number that classes share which are linked by shingle sets `similarity` alike."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw("text").alias("text")).withColumn("hash", F.xxhash64("text"))
    often, counts = often_shingles(texts, width)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                data = batch.column("text").to_pylist()
                owns = [shingle_set(x, width) for x in data]
                fps = pa.array(np.array([fingerprint(x) for x in data], np.uint64).view(np.int64))
                lists = [pa.array([f(x) for x in owns], pa.list_(pa.int64())) for f in (lambda x: prefix(x, similarity, often, counts), parity)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(map(text_key, data), pa.binary()), fps, pa.array(map(len, owns), pa.int64()), *lists], names=["doc_id", "hash", "key", "fp", "size", "prefix", "bits"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                # a text that only shares its hash with the class's is none of it
                same = [text_key(x) == key for x, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist())]
                batch = batch.filter(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(x, width) for x in batch.column("text").to_pylist()], pa.list_(pa.int64()))], names=["node", "own"])

    spark = docs.sparkSession
    # tables that a later step writes over, or that are emptied once they have served
    path = {x: new_path(spark) for x in ("rows", "nodes", "live", "next", "holders", "pairs", "ends", "own")}
    rows = written(texts.mapInArrow(sketch, "doc_id long, hash long, key binary, fp long, size long, prefix array<long>, bits array<long>"), path["rows"])
    classes = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first(F.struct("hash", "fp", "size", "prefix", "bits")).alias("x"))
    # the numbers hold once they are written
    nodes = written(classes.select(F.monotonically_increasing_id().alias("node"), "key", "least", "x.*"), path["nodes"])
    rows = written(rows.select("doc_id", "key"))
    emptied(spark, path["rows"])
    live = written(first_holders(nodes, similarity), path["live"])
    nodes = written(nodes.drop("prefix"))
    emptied(spark, path["nodes"])

    def exact(met: DataFrame) -> DataFrame:
        """The pairs that are alike, by the shingles of just those texts that the sketches leave."""
        pairs = written(possible(met, nodes, similarity), path["pairs"])
        if pairs.isEmpty():
            return spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
        ends = written(nodes.select("node", "key", "hash").join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi"), path["ends"])
        # of equal texts one does; another text with this hash stays until its key is looked at
        met = on_slots(texts, ends, "hash").join(ends, "hash").withColumn("more", F.xxhash64(F.lit(1), "text")).dropDuplicates(["node", "more"])
        own = written(met.select("node", "key", "text").mapInArrow(sets, "node long, own array<long>"), path["own"])
        side = lambda name: own.select(F.col("node").alias(name), F.col("own").alias(f"own_{name}"))
        shared = F.size(F.array_intersect("own_a", "own_b"))
        return written(pairs.join(side("a"), "a").join(side("b"), "b").where(shared >= similarity * (F.size("own_a") + F.size("own_b") - shared)).select("a", "b"))

    # groups by fingerprints; what those miss meets by prefixes, unless it is of one group by then
    tried = written(near_fingerprints(nodes.select("node", "fp")))
    alike = exact(tried)
    roots = components(alike)
    met = ordered(live.where("node != holder.node").where(can_meet(similarity))).join(tried, ["a", "b"], "left_anti")
    met = written(apart(met, roots))
    more = exact(met)
    if not more.isEmpty():
        alike = alike.union(more)
        roots = components(alike)
    tried = tried.union(met)
    # a shingle that one set alone is indexed by is done with now, others once all that weren't its holder are of one root;
    # until then more of them become holders. Who was a holder still meets smaller ones
    live = live.where("several").select("token", "node", "size", "pos", (indexed(similarity) & (F.col("node") != F.col("holder.node"))).alias("waits"))
    salts = SALTS
    while True:
        live = live.join(roots, "node", "left").select("token", "node", "size", "pos", "waits", F.coalesce("root", "node").alias("root"))
        several = live.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("waits").alias("more")).where("lo < hi and more").select("token")
        live = written(live.join(several, "token"), path["next"])
        path["live"], path["next"] = path["next"], path["live"]
        if live.isEmpty():
            break
        holders = live.where("waits").groupBy("token", F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt")).agg(F.min(F.struct("size", "pos", "node", "root")).alias("holder"))
        holders = written(holders.select("token", "holder"), path["holders"])
        met = live.join(holders, (live["token"] == holders["token"]) & (F.col("root") != F.col("holder.root")) & can_meet(similarity))
        met = written(ordered(met).join(tried, ["a", "b"], "left_anti"))
        more = exact(met)
        if not more.isEmpty():
            alike = alike.union(more)
            roots = components(alike)
        tried = tried.union(met)
        done = holders.select("token", F.col("holder.node").alias("node"), F.lit(True).alias("was"))
        live = live.drop("root").join(done, ["token", "node"], "left").withColumn("waits", F.col("waits") & F.col("was").isNull()).drop("was")
        salts *= SALTS
    return rows.select("doc_id", "key"), nodes.select("node", "key", "least").join(roots, "node", "left").select("key", "least", F.coalesce("root", "node").alias("root"))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = NEAR_SHINGLE) -> DataFrame:
    """doc_id, key, component_id for each row of docs: texts of equal words, and texts whose `width`-word shingles are
    `similarity` alike, are one group; component_id is its smallest doc_id.

    A group without any doc_id has a null component_id. Null text: no words.
    """
    rows, classes = near_classes(docs, similarity, width)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(classes.join(least, "root").select("key", "component_id"), "key").select("doc_id", "key", "component_id")


def simhash_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each near-duplicate group: the one with the smallest doc_id stays, whole, with
    all columns of docs. Texts are what is grouped: of rows that repeat a doc_id with unlike texts each stays, of rows that
    repeat it with one text one stays; a group without any doc_id keeps one row."""
    _, classes = near_classes(docs, similarity, NEAR_SHINGLE)
    # null doc_ids come last
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("nameless"), "least", "key")).alias("x"))
    # joined and made distinct on the same columns: texts cross one exchange, and copies of one text are dealt by their doc_ids
    at = ["__key", "__doc", "__nameless"]
    keep = written(best.select(F.col("x.key").alias("__key"), F.coalesce("x.least", F.lit(0)).alias("__doc"), F.col("x.nameless").alias("__nameless")))
    own = F.col("doc_id").cast("long")
    named = keyed(docs).withColumns({"__doc": F.coalesce(own, F.lit(0)), "__nameless": own.isNull()})
    return named.join(keep, at).dropDuplicates(at).select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with their texts' keys."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([text_key((x or "").encode()) for x in batch.column(where).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "__key"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__key", BinaryType())]))
