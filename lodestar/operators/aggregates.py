"""Counts by axis, tag health, ledger scores and coverage, requirement gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.layout import stored
def stats(records: DataFrame, axes: list[str], tag_column: str | None = None) -> DataFrame:
    """axis, value, n: the total and counts by each axis, in one pass over grouping sets; tags exploded apart."""
    plain = [a for a in axes if a != tag_column]
    rows = records.select(*(F.col(a).cast("string").alias(a) for a in plain))
    sets = [[F.col(a)] for a in plain] + [[]]
    counted = rows.groupingSets(sets, *plain).agg(F.count("*").alias("n"), F.grouping_id(*plain).alias("__g"))
    name, value = F.lit("total"), F.lit(None).cast("string")
    for k, a in enumerate(plain):
        own = F.col("__g") == (1 << len(plain)) - 1 - (1 << (len(plain) - 1 - k))
        name, value = F.when(own, a).otherwise(name), F.when(own, F.col(a)).otherwise(value)
    out = counted.select(name.alias("axis"), value.alias("value"), "n")
    if tag_column:
        out = out.unionByName(records.select(F.explode(tag_column).alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit(tag_column).alias("axis"), "value", "n"))
    return out


def tag_health(used: DataFrame, canon: DataFrame) -> DataFrame:
    """tag, n, status for each tag of `used` (one row a use) or `canon`: ghost, noncanon, singleton or ok."""
    counted = used.groupBy("tag").agg(F.count("*").alias("n"))
    both = counted.join(canon.select("tag").distinct().withColumn("__canon", F.lit(True)), "tag", "full_outer")
    status = F.when(F.col("n").isNull(), "ghost").when(F.col("__canon").isNull(), "noncanon").when(F.col("n") == 1, "singleton").otherwise("ok")
    return both.select("tag", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def under_tagged(members: DataFrame, tags: DataFrame, mode: str = "majority", present_fraction: float = 0.6, max_missing: int = 2, limit: int | None = None) -> DataFrame:
    """facet, tag, present, missing, confidence: tags that most of a facet's members have and few lack.

    members: facet, member. tags: member, tag. majority: at least present_fraction have it and 1 to max_missing lack it;
    any: some have it and some lack it; off: nothing. Ranked by confidence; limit caps the report where one is given.
    """
    size = members.groupBy("facet").agg(F.count_distinct("member").alias("size"))
    have = members.join(tags, "member").groupBy("facet", "tag").agg(F.count_distinct("member").alias("present"))
    cells = have.join(size, "facet").select("facet", "tag", "present", (F.col("size") - F.col("present")).alias("missing"), F.round(F.col("present") / F.col("size"), 6).alias("confidence"))
    keep = {"majority": (F.col("confidence") >= present_fraction) & F.col("missing").between(1, max_missing), "any": F.col("missing") >= 1, "off": F.lit(False)}[mode]
    out = cells.where(keep)
    return out.orderBy(F.desc("confidence"), "missing", "facet", "tag").limit(limit) if limit else out


def under_tagged_members(members: DataFrame, tags: DataFrame, cells: DataFrame) -> DataFrame:
    """facet, tag, member: who lacks the tag in each cell."""
    return cells.select("facet", "tag").join(members, "facet").join(tags, ["member", "tag"], "left_anti").select("facet", "tag", "member")


def cell_means(rows: DataFrame, keys: list[str], value: str, enough: int = 5) -> DataFrame:
    """keys, n, mean (1 decimal), runway: rows that a cell still needs to be stable."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(F.col(value).cast("double")), 1).alias("mean")).withColumn("runway", F.greatest(F.lit(0), F.lit(enough) - F.col("n")))


def runway_summary(cells: DataFrame, enough: int = 5) -> DataFrame:
    return cells.agg(F.count("*").alias("cells"), F.count_if(F.col("n") >= enough).alias("stable"), F.coalesce(F.sum("runway"), F.lit(0)).alias("needed"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count_distinct(column).alias("n"), F.array_sort(F.collect_set(column)).alias("values"))


def coverage_totals(cards: DataFrame, ledger: DataFrame) -> DataFrame:
    """cards, audited, structural, content, rows. A note audited counts even if its card is gone."""
    count = lambda kind: F.count_distinct(F.when(F.col("audit_type") == kind, F.col("note")))
    made = ledger.agg(F.count_distinct("note").alias("audited"), count("structural").alias("structural"), count("content").alias("content"), F.count("*").alias("rows"))
    return made.join(F.broadcast(cards.agg(F.count("*").alias("cards"))), F.lit(True)).select("cards", "audited", "structural", "content", "rows")


def out_degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return edges.groupBy(source).agg(F.count_distinct(target).alias("n"))


def tag_counts(records: DataFrame, most: int, gated: list[str] | None = None, name: str = "name") -> DataFrame:
    """name, n for records with more tags than allowed; gated tags don't count if they are given."""
    tags = F.array_except("tags", F.array(*map(F.lit, gated))) if gated else F.col("tags")
    return records.select(name, F.size(tags).alias("n")).where(F.col("n") > most)


def index_stats(chunks: DataFrame, refreshed: str) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.max(refreshed).alias("last_refresh"))


def requirement_gaps(records: DataFrame, requirements: DataFrame, present: Column, created: str = "created") -> DataFrame:
    """kind, requirement, defects, drift: records of a kind that lack a requirement, by whether they are older than it.

    records: kind, created, and what `present` looks at; `requirement` is in scope for it. An equi-join on kind.
    """
    rows = records.join(requirements, "kind").where(~present)
    older = F.col(created) < F.col("introduced")
    return rows.groupBy("kind", "requirement").agg(F.count_if(~F.coalesce(older, F.lit(False))).alias("defects"), F.count_if(older).alias("drift"))


# ---- windows over ledgers


def latest(rows: DataFrame, keys: list[str], ts: str, tie: list[str]) -> DataFrame:
    """The row with the greatest ts of each key; the earliest in order of `tie` wins among equals.

    Spark limits each task's rows of a key to the first before it shuffles them (WindowGroupLimit), so hot keys stay small.
    """
    by = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), *tie)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def pivoted(rows: DataFrame, key: str, axis: str, values: list[str], value: str) -> DataFrame:
    """One row a key with a column for each axis value."""
    return rows.groupBy(key).pivot(axis, values).agg(F.first(value))


def last_of(rows: DataFrame, columns: list[str], name: str = "last") -> DataFrame:
    return rows.withColumn(name, F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]))


def pristine(rows: DataFrame, key: str, order: list[str], fixed: Column) -> DataFrame:
    """`pristine`: no earlier row of the same key was a fix. Equal orders aren't earlier.

    The first fix of each key is a pre-aggregated minimum that joins back, so a key with a third of all rows is neither
    sorted nor held in one task, as it would be by a running maximum.
    """
    first = rows.where(fixed).groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    joined = rows.join(first.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn("pristine", F.col("__first").isNull() | (F.struct(*order) <= F.col("__first"))).drop("__key", "__first")


def followers(rows: DataFrame, key: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """key, source, target: each value with the next one of its key.

    Rows are followed within (key, bucket), where the bucket is a coarse prefix of the order, such as a day; only the first
    row of each bucket is looked at across buckets. A key with very many rows is so sorted in as many tasks as it has buckets.
    """
    own = rows.select(F.col(key), F.struct(*order).alias("__at"), F.col(value).alias("source"), bucket.alias("__bucket"))
    inside = own.withColumn("__next", F.lead("source").over(Window.partitionBy(key, "__bucket").orderBy("__at")))
    firsts = own.groupBy(key, "__bucket").agg(F.min(F.struct("__at", "source"))["source"].alias("__first"))
    after = firsts.select(F.col(key).alias("__key"), F.col("__bucket").alias("__b"), F.lead("__first").over(Window.partitionBy(key).orderBy("__bucket")).alias("__after"))
    joined = inside.join(after, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__b")))
    return joined.select(key, "source", F.coalesce("__next", "__after").alias("target")).where("target is not null")


def suppress_repeats(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a repeat with the same input hash is no new measurement."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


# ---- orders


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place in a total order, from 1. Rows are dealt out by ranges of the order; a range's places begin behind
    the counts of those before it, so that no task meets all rows. Rows that the order doesn't tell apart follow each other."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    # one row for each range
    before = dealt.groupBy("__range").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def ranking_order(first_pos: str) -> list[Column]:
    """By mean, the best first, then by first appearance."""
    return [F.desc("mean"), F.asc(first_pos)]


def ranking(cells: DataFrame, first_pos: str) -> DataFrame:
    return cells.orderBy(*ranking_order(first_pos))


def card_order(cards: DataFrame, last: str = "last", created: str = "created", path: str = "path") -> list[Column]:
    """Audited cards by last audit, newest first; then the others by creation, newest first, and path."""
    return [F.col(last).desc_nulls_last(), F.when(F.col(last).isNull(), F.coalesce(F.col(created).cast("string"), F.lit(""))).desc_nulls_last(), F.col(path).asc()]


def card_tier(last: str) -> Column:
    return F.when(F.col(last).isNotNull(), 0).otherwise(1)


def history_order() -> list[Column]:
    return [F.col("ts").desc_nulls_last(), F.col("note").asc(), F.col("audit_type").asc()]


def history(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(*history_order())


def chronological_order(year: str = "year", name: str = "name") -> list[Column]:
    return [F.col(year).asc_nulls_last(), F.col(name).asc()]


def chronological(records: DataFrame, year: str = "year", name: str = "name") -> DataFrame:
    return records.orderBy(*chronological_order(year, name))


def top_per_axis(rows: DataFrame, axis: str, score: str, key: str, n: int) -> DataFrame:
    """The n best of each axis; a view over scores."""
    by = Window.partitionBy(axis).orderBy(F.col(score).desc_nulls_last(), F.col(key))
    return rows.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def ranked_models(ledger: DataFrame, judge_prefix: str, enough: int = 5) -> tuple[DataFrame, DataFrame]:
    """The ranking dashboard: mean by (authored_model, audit_type) over eligible rows, and its stability summary."""
    from lodestar.operators.filters import eligible

    cells = cell_means(eligible(ledger, judge_prefix).where(F.col("score").isNotNull()), ["authored_model", "audit_type"], "score", enough)
    return cells.orderBy("audit_type", F.desc("mean"), "authored_model"), runway_summary(cells, enough)


def coverage(cards: DataFrame, ledger: DataFrame, axes: tuple[str, str] = ("structural", "content")) -> DataFrame:
    """The coverage dashboard: each card with its latest score and time by axis, in card order.

    cards: path, created. ledger: note (a path), audit_type, score, ts, file_pos.
    """
    newest = latest(ledger.where(F.col("audit_type").isin(*axes)), ["note", "audit_type"], "ts", ["file_pos"])
    wide = newest.groupBy("note").pivot("audit_type", list(axes)).agg(F.first("score").alias("score"), F.first("ts").alias("ts"))
    joined = cards.join(wide, cards["path"] == wide["note"], "left").drop("note")
    shown = joined.withColumn("last", F.greatest(*(F.col(f"{a}_ts") for a in axes)))
    return shown.orderBy(*card_order(shown))
