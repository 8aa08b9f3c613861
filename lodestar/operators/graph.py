"""References between records: who points where, what dangles, and which relations lack their mirror.

All operators take an edge table with `source` and `target` (names can be given), so they run over wiki links, embeds,
front-matter references or any other pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import tokens
from lodestar.operators.mentions import few_terms, mentions


def backlinks(edges: DataFrame, targets: DataFrame | list | str, source: str = "source", target: str = "target") -> DataFrame:
    """Edges to the given target, targets or table of targets (column of that name)."""
    if isinstance(targets, DataFrame):
        return edges.join(targets.select(target).distinct(), target, "left_semi")
    return edges.where(F.col(target).isin(*targets) if isinstance(targets, list) else F.col(target) == targets)


def broken(edges: DataFrame, records: DataFrame, target: str = "target", name: str = "name") -> DataFrame:
    """Edges whose target isn't a record. Names match in their exact case and with no suffix stripped; null targets aren't edges."""
    known = records.select(F.col(name).alias("__known"))
    return edges.where(F.col(target).isNotNull()).join(known, F.col(target) == F.col("__known"), "left_anti")


def orphans(records: DataFrame, edges: DataFrame, name: str = "name", target: str = "target", exempt: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Records that no edge points to."""
    rows = records.where(~F.col(name).isin(*exempt)) if exempt else records
    if folder:
        rows = rows.where(F.col("path").startswith(folder))
    return rows.join(edges.select(F.col(target).alias("__target")), F.col(name) == F.col("__target"), "left_anti")


def duplicates(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return edges.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def one_way(edges: DataFrame, source: str = "source", target: str = "target", carry: list[str] | None = None) -> DataFrame:
    """Distinct edges a to b without b to a; an edge to itself is its own reverse. carry: columns that must agree both ways."""
    keys = carry or []
    own = edges.select(source, target, *keys).distinct().where(F.col(source) != F.col(target))
    back = own.select(F.col(target).alias("__s"), F.col(source).alias("__t"), *(F.col(k).alias(f"__{k}") for k in keys))
    same = (F.col(source) == F.col("__s")) & (F.col(target) == F.col("__t"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return own.join(back, same, "left_anti")


def asymmetric(edges: DataFrame, kinds: DataFrame, pairs: DataFrame | None = None, severity: str = "WARN") -> DataFrame:
    """source, target, source_kind, target_kind, missing_reverse_from, severity for one-way edges between records.

    kinds: name, kind. pairs: source_kind, target_kind to look at; all if none are given.
    """
    found = one_way(edges)
    of = lambda who: kinds.select(F.col("name").alias(who), F.col("kind").alias(f"{who}_kind"))
    rows = found.join(of("source"), "source").join(of("target"), "target")
    if pairs is not None:
        rows = rows.join(pairs, ["source_kind", "target_kind"], "left_semi")
    return rows.select("source", "target", "source_kind", "target_kind", F.col("target").alias("missing_reverse_from"), F.lit(severity).alias("severity"))


def resolve(edges: DataFrame, records: DataFrame, target: str = "target", name: str = "name") -> DataFrame:
    """All edges with `resolved`: whether the target is a record. Unresolved targets stay plain text and are no error."""
    known = records.select(F.col(name).alias("__known")).distinct().withColumn("__found", F.lit(True))
    return edges.join(known, F.col(target) == F.col("__known"), "left").withColumn("resolved", F.coalesce("__found", F.lit(False))).drop("__known", "__found")


def mirror_gaps(left: DataFrame, right: DataFrame, keys: list[str], sides: tuple[str, str] = ("right", "left")) -> DataFrame:
    """keys and missing_on: key tuples that only one side has, each way by an anti-join."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing_on", F.lit(sides[0])).unionByName(b.join(a, keys, "left_anti").withColumn("missing_on", F.lit(sides[1])))


def role_mirror(works: DataFrame, credits: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """Mirror of credits (title, person, role) in works (title, person, role), where a credit's role maps to several.

    Gives credits without any of their roles in works, and works with a mapped role without a credit.
    """
    spark = works.sparkSession
    mapping = spark.createDataFrame([(k, x) for k, own in roles.items() for x in own], "role string, other string")
    wanted = credits.select("title", "person", "role").distinct()
    matched = wanted.join(mapping, "role").join(works.select("title", "person", F.col("role").alias("other")), ["title", "person", "other"], "left_semi").select("title", "person", "role")
    gaps = wanted.join(matched, ["title", "person", "role"], "left_anti").withColumn("missing_on", F.lit("works"))
    owed = works.join(mapping.select(F.col("other").alias("role")).distinct(), "role", "left_semi").select("title", "person", "role").distinct()
    return gaps.unionByName(owed.join(wanted.select("title", "person"), ["title", "person"], "left_anti").withColumn("missing_on", F.lit("credits")))


def cast_mirror(featured: DataFrame, links: DataFrame, names: DataFrame, heading: str) -> DataFrame:
    """Titles that a character lists (source, target) against the characters linked under a heading of the title's note."""
    section = F.element_at(F.split("section_path", " / "), -1) == heading
    listed = links.where(section).join(names.select("path", F.col("name").alias("title")), "path").select("title", F.col("target").alias("character"))
    return mirror_gaps(featured.select(F.col("target").alias("title"), F.col("source").alias("character")), listed, ["title", "character"], ("cast section", "featured list"))


def required_links(references: DataFrame, records: DataFrame, links: DataFrame) -> DataFrame:
    """Front-matter references (source, field, target) to existing records that the source's body doesn't link."""
    wanted = references.join(records.select(F.col("name").alias("target")).distinct(), "target", "left_semi")
    return wanted.select("source", "field", "target").distinct().join(links.select("source", "target"), ["source", "target"], "left_anti")


def sourced(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links by path with the note's name as source."""
    return links.join(notes.select("path", F.col("name").alias("source")), "path")


def missing_thumbnails(gallery: DataFrame, notes: DataFrame, cover: Column, widths: dict[str, int], default: int) -> DataFrame:
    """Inbound gallery bullets without the target's cover, or with another width: path, line, target, cover, width, wanted."""
    wanted = F.lit(default)
    for kind, width in widths.items():
        wanted = F.when(F.col("kind") == kind, width).otherwise(wanted)
    covers = notes.select(F.col("name").alias("target"), F.col("note_kind").alias("kind"), cover.alias("cover")).where("cover is not null and cover != ''")
    rows = gallery.select("path", "line", "target", "file", "width").join(covers, "target").withColumn("wanted", wanted)
    return rows.where(~F.col("file").eqNullSafe(F.element_at(F.split("cover", "/"), -1)) | ~F.col("width").eqNullSafe(F.col("wanted"))).select("path", "line", "target", "cover", "width", "wanted")


def shared_names(notes: DataFrame) -> DataFrame:
    """Names that several files share, with their paths' number."""
    return notes.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def mention_terms(notes: DataFrame, fields: list[str]) -> DataFrame:
    """target, term: a note's name (underscores as spaces), aliases and name fields."""
    own = [F.array(F.regexp_replace("name", "_", " ")), F.col("aliases"), *(F.array(F.get_json_object(F.to_json("extra"), f"$.{x}")) for x in fields)]
    return notes.select(F.col("name").alias("target"), F.explode(F.array_distinct(F.concat(*own))).alias("term")).where("term is not null and length(trim(term)) > 1")


def text_mentions(lines: DataFrame, terms: DataFrame, links: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Plain-text mentions: keys, target, term. lines: keys, text, one row for each keys. terms: target, term. links: keys, target,
    left out.

    Terms are counted first. As many as one automaton takes are found in one pass over lines; beyond, lines and terms meet on
    words. Both give the same rows.
    """
    keys = keys or ["path", "line"]
    few = few_terms(terms)
    found = mentions(lines, few, keys, terms) if few is not None else mentions_by_words(lines, terms, keys)
    return found.join(links.select(*keys, "target"), [*keys, "target"], "left_anti") if links is not None else found


def mentions_by_words(lines: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """A theta join would compare every line with every term. Here both meet on that word of the term which the fewest lines
    have; each line has a word once. A term of one word is found by that; longer ones are verified in their line, as literal
    text between non-letters, in any script. Lines' texts don't travel with their words.
    """
    words = lines.select(*keys, F.explode(F.array_distinct(tokens("text"))).alias("word"))
    of_terms = terms.select("target", "term", F.explode(F.array_distinct(tokens("term"))).alias("word")).withColumn("single", F.lower("term") == F.col("word"))
    # only terms of several words have a choice
    longer_terms = of_terms.where("not single")
    often = words.join(longer_terms.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = longer_terms.join(often, "word", "left").groupBy("target", "term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("x"))
    singles = words.join(of_terms.where("single").select("word", "target", "term"), "word").select(*keys, "target", "term")
    met = words.join(rarest.select("target", "term", F.col("x.word").alias("word")), "word").select(*keys, "target", "term")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), F.regexp_replace("term", r"\\E", ""), F.lit(r"\E(?![\p{L}\p{N}_])"))
    longer = met.join(lines.select(*keys, "text"), keys).where(F.rlike("text", pattern))
    return singles.unionByName(longer.select(*keys, "target", "term")).distinct()


def first_occurrences(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first edge of each key; the others are duplicates."""
    return edges.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def both_kinds(links: DataFrame, embeds: DataFrame) -> DataFrame:
    """Links and embeds as one edge table: source_path, line, target, display_text."""
    return links.select(F.col("path").alias("source_path"), "line", "target", "display_text").unionByName(embeds.select(F.col("path").alias("source_path"), "line", F.col("file").alias("target"), F.col("width").cast("string").alias("display_text")))


def only_left(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Set difference of two sides, duplicates removed."""
    return left.select(*columns).subtract(right.select(*columns))
