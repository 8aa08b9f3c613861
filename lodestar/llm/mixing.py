"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources share the mix by weight, none above a multiple of its size (the excess is shared anew). The target is cut in blocks
of equal tokens: sources get blocks by highest quotients, and within a source its shards do. A shard's documents stand on
a line in a seeded order; its quota is whole passes over the line and a seeded run of blocks. Shards keep a hot source's
documents in many tasks, and only sums for each shard meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import raw, written

# Fixed values of the contract.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, SHARD_TOKENS, SEED = 64, 1 << 20, 42


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2 * seats + 1), ties to the earlier one, none above `most`.

    A common divisor gives nearly all seats at once; the highest of the quotients at its edge get the rest, one each.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), seats, np.int64) if most is None else np.asarray(most, np.int64)
    if not len(votes) or votes.sum() <= 0:
        return np.zeros(len(votes), np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    give = lambda d: np.minimum(np.floor(votes / d + 0.5).astype(np.int64), most)
    low, high = votes.sum() / (4.0 * max(seats, 1) + 4 * len(votes)), 4 * votes.sum() + 1
    while give(low).sum() < seats:
        low /= 2
    for _ in range(200):  # give(low) has seats enough, give(high) no more than seats
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if give(mid).sum() >= seats else (low, mid)
    out = give(high)
    while (left := seats - int(out.sum())) > 0:
        edge = np.flatnonzero((out < most) & (votes > 0))
        # only quotients that are all but equal are at the edge, so each takes one seat before any takes a second
        quotients = votes[edge] / (2 * out[edge] + 1)
        first = edge[np.lexsort((edge, -quotients))][:left]
        top = quotients.max()
        out[[k for k in first if votes[k] / (2 * out[k] + 1) >= top * (1 - 1e-9)]] += 1
    return out


def seeded() -> Column:
    """A seeded order of rows with doc_id, text and source; rows that are equal in these share it."""
    return F.xxhash64(F.lit(SEED), *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("doc_id", "text")), F.col("source").isNull(), F.col("source").cast("string"))


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and a seeded order for each row."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            sizes = [len(x.split()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64()), batch.column("ordered")], names=["doc_id", "source", "size", "ordered"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), raw("text").alias("text"), seeded().alias("ordered"))
    return rows.mapInArrow(run, "doc_id long, source string, size long, ordered long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: a row for each source. Water-filling: with t = capacity / weight ascending, sources up to
    some t are full, and all others share what is left by weight.

    Only one row for each source is ordered here.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("rank") % len(weights) + 1)
    ranked = by_source.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    filled = ranked.withColumn("weight", weight).withColumn("capacity", F.col("source_size") * F.lit(float(most))).withColumn("t", F.col("capacity") / F.col("weight"))
    before = Window.orderBy("t", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = filled.select(
        "*",
        F.coalesce(F.sum("capacity").over(before), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("passed"),
        F.sum("weight").over(every).alias("weights"),
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("budget"),
    ).withColumn("rate", (F.col("budget") - F.col("full")) / (F.col("weights") - F.col("passed")))
    # the first source, by t, whose capacity isn't reached at its rate fixes the level for it and all after it
    final = level.withColumn("level", F.min(F.when(F.col("rate") <= F.col("t"), F.struct("t", "rank", "rate"))).over(every))
    target = F.when(F.col("level").isNull() | (F.struct("t", "rank") < F.struct("level.t", "level.rank")), F.col("capacity")).otherwise(F.col("level.rate") * F.col("weight"))
    return final.select("source", "source_size", F.least(target, "capacity").alias("target"))


def apportion(key: str, votes: str, seats: str, most: str | None, out: str):
    """A function for applyInPandas: adds column `out`, each row's seats among the group's rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable", na_position="last").reset_index(drop=True)
        total = rows[seats].iloc[0] if len(rows) else 0
        return rows.assign(**{out: sainte_lague(rows[votes].to_numpy(), int(total), None if most is None else rows[most].to_numpy())})

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each row of docs (doc_id, source, text): doc_id, size, source_size, target, taken, source.

    taken: words of the document that the mix takes, at most `most` times its size. Null or empty text: size and taken zero.
    Null source: a source of its own, last. The order hangs on doc_id and text, so rows that repeat are interchangeable and
    reruns agree. An empty table gives an empty result; other columns are ignored.
    """
    sizes = written(word_sizes(docs))
    targets = written(source_targets(sizes, weights, share, most))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens))
    placed = sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("shard", F.pmod("ordered", shards))
    # a source's shards are in groups, about as many as a group has shards, so that no task meets all shards of a large source
    grouped = F.floor(F.col("shard") / F.ceil(F.sqrt(shards)))
    line = written(
        placed.groupBy("source", "source_size", "target", "shard").agg(F.sum("size").alias("length"))
        .select("source", grouped.cast("long").alias("part"), F.col("shard").cast("long").alias("shard"), "length", (F.ceil(F.col("length") / block) * most).cast("long").alias("most_blocks"))
    )
    # sources, then their groups of shards, then shards get integer quotas of blocks; one row for each source meets in a task
    total = F.sum("target").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sources = targets.withColumn("seats", F.coalesce(F.round(total / block), F.lit(0)).cast("long")).withColumn("one", F.lit(1))
    quotas = sources.groupBy("one").applyInPandas(apportion("source", "target", "seats", None, "blocks"), "source string, source_size long, target double, seats long, one int, blocks long").select(F.col("source").alias("of"), "blocks")
    parts = line.groupBy("source", "part").agg(F.sum("length").alias("length"), F.sum("most_blocks").cast("long").alias("most_blocks")).join(quotas, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    by_part = parts.groupBy("source").applyInPandas(apportion("part", "length", "blocks", "most_blocks", "quota"), "source string, part long, length long, most_blocks long, blocks long, quota long")
    of_part = by_part.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.col("quota").alias("blocks"))
    dealt = line.join(of_part, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).drop("of", "of_part")
    by_shard = dealt.groupBy("source", "part").applyInPandas(apportion("shard", "length", "blocks", "most_blocks", "quota"), "source string, part long, shard long, length long, most_blocks long, blocks long, quota long")
    quota = by_shard.select(F.col("source").alias("of"), F.col("shard").alias("of_shard"), "length", "quota")
    before = Window.partitionBy("source", "shard").orderBy("ordered", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    on_line = placed.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("end", F.col("begin") + F.col("size"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("length") / block))
    joined = on_line.join(quota, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("of_shard")))
    run = joined.select(
        "*", F.floor(F.col("quota") / n_blocks).alias("passes"), (F.col("quota") % n_blocks).alias("extra"), F.pmod(F.xxhash64(F.lit(SEED), F.coalesce("source", F.lit("")), "shard"), n_blocks).alias("from"), n_blocks.alias("n_blocks")
    )
    # the extra blocks are a run from a seeded block on, round the line's end
    cut = lambda a, b: F.greatest(F.lit(0), F.least("end", F.least(b, F.col("length"))) - F.greatest(F.col("begin"), a))
    first = F.col("from") * block
    to = F.col("from") + F.col("extra")
    once = cut(first, F.least(to, F.col("n_blocks")) * block) + F.when(to > F.col("n_blocks"), cut(F.lit(0), (to - F.col("n_blocks")) * block)).otherwise(0)
    taken = (F.col("passes") * F.col("size") + once).cast("long")
    return run.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "ordered")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each document as many times as its taken words are multiples of its size, rounded; all
    but the two documents at the ends of a shard's run are taken whole. Columns as they were.

    Documents without a word go: they add nothing to a mix. Null sources are a source of their own. Rows that repeat another
    are taken as often as all of them together.
    """
    keyed = docs.withColumn("__ordered", seeded())
    times = mix(docs, **options).withColumn("times", F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int"))
    # rows that repeat share a key: their copies are summed, and come from one of them; one exchange of texts serves both
    wanted = times.groupBy("ordered").agg(F.sum("times").cast("int").alias("__times")).where("__times > 0").withColumnRenamed("ordered", "__ordered")
    one = keyed.dropDuplicates(["__ordered"])
    return one.join(wanted, "__ordered").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
