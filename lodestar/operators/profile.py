"""Composite views of one record, the closing gate, and plans for write flows that edit no file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import both_kinds, one_way, sourced


def _list(rows: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """One row a key with its rows as a sorted list; only rows of the profiled record get here."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def note_profile(notes: DataFrame, links: DataFrame, embeds: DataFrame, issues: DataFrame, note: str) -> DataFrame:
    """One row: the record with its outgoing links, backlinks and issues. Each part is filtered to the note before it is gathered."""
    record = notes.where(F.col("name") == note).select("path", "name", "note_kind", "quality", "tags", "n_lines")
    outgoing = _list(links.join(record.select("path"), "path", "left_semi"), "path", "outgoing", ["line", "target"])
    back = both_kinds(links, embeds).where(F.col("target") == note).withColumn("name", F.lit(note))
    found = _list(issues.join(record.select("path"), "path", "left_semi"), "path", "lint", ["rule", "severity", "detail"])
    return record.join(outgoing, "path", "left").join(_list(back, "name", "backlinks", ["source_path", "line", "display_text"]), "name", "left").join(found, "path", "left")


def card_closed(notes: DataFrame, green: DataFrame, links: DataFrame) -> DataFrame:
    """path, structural_green, one_way_links, closed: no structural error, and every link to a note has its reverse."""
    edges = sourced(links, notes).join(notes.select(F.col("name").alias("target")), "target", "left_semi")
    open_ = one_way(edges.select("source", "target")).groupBy("source").agg(F.count("*").alias("one_way_links"))
    rows = green.join(notes.select("path", F.col("name").alias("source")), "path").join(open_, "source", "left")
    n = F.coalesce("one_way_links", F.lit(0))
    return rows.select("path", "structural_green", n.alias("one_way_links"), (F.col("structural_green") & (n == 0)).alias("closed"))


def rename_plan(links: DataFrame, embeds: DataFrame, old: str, new: str) -> DataFrame:
    """What renaming a note would edit: path, line, before, after. Files stay as they are."""
    rows = both_kinds(links, embeds).where(F.col("target") == old)
    return rows.select(F.col("source_path").alias("path"), "line", F.concat(F.lit("[["), "target").alias("before"), F.lit(f"[[{new}").alias("after"))


def shortened(text: Column, most: int) -> Column:
    """A text and all that is left of it without up to `most` characters."""
    once = lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))))
    found = F.array(text)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(F.filter(found, lambda x: x != ""), once))))
    return found


def plain_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.md$", ""))


def fix_plan(broken: DataFrame, notes: DataFrame, most: int = 2) -> DataFrame:
    """Broken links with the nearest existing name: path, line, target, proposal, distance, n_names (that are as near).

    distance counts edits of single characters, case and suffix aside; a link without a name within `most` has no row. The
    proposal is the first of the nearest names. Names and targets meet on what is left of both without a few characters, never
    each with each; names that such a meeting brings together but are farther apart are left out.
    """
    targets = broken.select("target").distinct().withColumn("plain", plain_name(F.col("target"))).withColumn("wanted", F.xxhash64("plain"))
    names = notes.select("name").distinct().withColumnRenamed("name", "proposed").withColumn("plain", plain_name(F.col("proposed"))).withColumn("found", F.xxhash64("plain"))
    # one hash for a text or a shortened one: equal ones are verified below
    keyed = lambda rows, of, texts: rows.select(of, F.explode(F.array_distinct(F.transform(texts, lambda x: F.xxhash64(x)))).alias("key"))
    known = names.select("found", F.col("plain").alias("known")).distinct()
    asked = targets.select("wanted", "plain").distinct().join(known, F.col("plain") == F.col("known"), "left")
    # a target that is a name but for case and suffix has no nearer one, and is not shortened
    left = keyed(asked, "wanted", F.when(F.col("known").isNotNull(), F.array("plain")).otherwise(shortened(F.col("plain"), most)))
    right = keyed(known, "found", shortened(F.col("known"), most))
    # Spark takes the side of names for as small as before they were shortened, and would broadcast it
    pairs = left.join(right.hint("merge"), "key").select("wanted", "found").distinct()
    met = pairs.join(targets, "wanted").join(names.withColumnRenamed("plain", "proposed_plain"), "found")
    near = met.select("target", F.col("proposed").alias("name"), F.levenshtein("plain", "proposed_plain", most).alias("distance")).where("distance >= 0")
    best = near.groupBy("target").agg(F.min(F.struct("distance", "name")).alias("x"))
    counted = near.join(best, "target").where("distance = x.distance").groupBy("target").agg(F.first("x").alias("x"), F.count("*").alias("n_names"))
    return broken.join(counted, "target").select("path", "line", "target", F.col("x.name").alias("proposal"), F.col("x.distance").alias("distance"), "n_names")


def image_plan(notes: DataFrame, embeds: DataFrame, file: str) -> DataFrame:
    """Where removing an image would edit: every embed of it."""
    return embeds.where(F.col("file") == file).join(notes.select("path", "name"), "path").select("path", "name", "line", "file")


def totals_profile(records: DataFrame, children: DataFrame, key: str, child_key: str, measures: dict[str, str]) -> DataFrame:
    """Records with scalar aggregates of their children; children are aggregated before the join."""
    made = children.groupBy(child_key).agg(F.count("*").alias("n_children"), *(F.expr(sql).alias(name) for name, sql in measures.items()))
    return records.join(made, records[key] == made[child_key], "left").drop(child_key).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
