"""Notes: Markdown files with typed front matter, read into records, lines, links, embeds, tables and chunks.

Each file is one row until its lines are split; all further tables are derived from lines with Spark's own functions.
Only YAML, which Spark can't read, is parsed in Python, batch by batch.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache, cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.cuts import cut_texts
from lodestar.functions.text import IMAGE, INLINE_LINK, URL, WIKI_LINK, basename, folder, mask_inline_code

CORE = "type string, domain string, stability string, priority string, note_kind string, quality string, co_authored string, created string, updated string, tags array<string>, aliases array<string>"
CORE_NAMES = [x.split()[0] for x in CORE.split(", ")]
FRONT = r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?\z"


def below(root: str, file: Column | None = None) -> Column:
    """A file's path below root. file: its full name where it isn't the one that is read."""
    whole = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")) if file is None else file
    return F.element_at(F.split(whole, rf"\Q/{root.rstrip('/').split('/')[-1]}/\E", 2), 2)


def scan(spark: SparkSession, root: str, suffix: str = ".md", files: list[str] | None = None) -> DataFrame:
    """path (below root), name, folder, mtime, size, content_hash, text: one row for each file, or for each of `files`."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(files or root, wholetext=True)
    rows = found.select(below(root).alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    return rows.select("path", basename("path", suffix).alias("name"), folder("path").alias("folder"), "mtime", "size", F.sha2("text", 256).alias("content_hash"), "text")


def listing(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """path (below root), mtime, size, file (full name): one row for each note's file. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select(below(root, F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("path").alias("file"))


def attachments(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """path (below root), mtime, size: one row for each file that is no note. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(below(root, F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).where(~F.col("path").endswith(suffix))


@cache
def _loader():
    """The C parser where PyYAML has it: several times as fast, the same values."""
    import yaml

    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def parse_yaml(block: str | None) -> tuple[str | None, str | None, str | None]:
    """Core fields and all others as JSON, and what is wrong with the block. Dates become ISO text, anchors are resolved."""
    import yaml

    if block is None:
        return None, None, None
    try:
        found = yaml.load(block, _loader())
    except yaml.YAMLError as e:
        return None, None, str(e).split("\n")[0][:200]
    if found is None:
        return "{}", "{}", None
    if not isinstance(found, dict):
        return None, None, "front matter is no mapping"
    found = {str(k): v for k, v in found.items()}
    listed = lambda v: v if isinstance(v, list) else [] if v in (None, "") else [v]
    core = {k: ([str(x) for x in listed(v) if x is not None] if k in ("tags", "aliases") else v if v is None else str(v)) for k, v in found.items() if k in CORE_NAMES}
    dump = lambda x: json.dumps(x, ensure_ascii=False, default=str)
    return dump(core), dump({k: v for k, v in found.items() if k not in CORE_NAMES}), None


def front_matter(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_yaml(x) for x in blocks], columns=["core", "extra", "error"])


def parse(files: DataFrame) -> DataFrame:
    """Scanned files as notes: core columns, all other front matter as a VARIANT `extra`, the body and line counts.

    A file without front matter, or with a malformed block, keeps its row: core columns null, `error` says why. Blocks are
    parsed once: a filter on what they hold isn't pushed below them, as the parser is not said to be deterministic.
    """
    split = files.withColumn("front", F.when(F.col("text").rlike(FRONT), F.regexp_extract("text", FRONT, 1))).withColumn("body", F.when(F.col("front").isNotNull(), F.regexp_extract("text", FRONT, 2)).otherwise(F.col("text")))
    parsed = split.withColumn("yaml", F.pandas_udf(front_matter, "struct<core:string,extra:string,error:string>").asNondeterministic()("front")).withColumn("core", F.from_json("yaml.core", CORE))
    lines = lambda x: F.size(F.split(x, r"\r?\n"))
    return parsed.select(
        "path", "name", "folder", "mtime", "size", "content_hash", *(F.col(f"core.{x}").alias(x) for x in CORE_NAMES if x not in ("tags", "aliases")),
        F.coalesce("core.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("core.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.parse_json(F.coalesce("yaml.extra", F.lit("{}"))).alias("extra"), F.col("yaml.error").alias("error"), lines(F.col("text")).alias("n_lines"), "body",
        F.when(F.col("front").isNull(), 0).otherwise(lines(F.col("text")) - lines(F.col("body"))).alias("front_lines"), "text",
    )


def nearest_above(rows: DataFrame, keys: list[str], order: str, heading: Column, name: str) -> DataFrame:
    """rows with the nearest non-null `heading` at or above each, within keys."""
    above = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(above))


def note_lines(notes: DataFrame) -> DataFrame:
    """path, line (from 1, front matter included), text, in_frontmatter, in_fence, is_heading, section_path.

    section_path: the headings above, outermost first, joined by " / "; a heading belongs to its own section.
    """
    lines = notes.select("path", "front_lines", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    above = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("in_frontmatter", F.col("line") <= F.col("front_lines")).withColumn("fence", ~F.col("in_frontmatter") & F.col("text").rlike(r"^\s*(```|~~~)"))
    # the line that closes a fence still belongs to it
    fenced = marked.withColumn("fences", F.count_if("fence").over(above)).withColumn("in_fence", F.col("fence") | (F.col("fences") % 2 == 1))
    level = F.when(~F.col("in_frontmatter") & ~F.col("in_fence") & F.col("text").rlike(r"^#{1,6}\s"), F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1)))
    headed = fenced.withColumn("level", level).withColumn("title", F.trim(F.regexp_replace("text", r"^#{1,6}\s+|\s+#*\s*$", "")))
    for k in range(1, 7):
        headed = headed.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("line", "title")), ignorenulls=True).over(above))
    deeper = [F.when(F.col(f"h{k}.line") > F.greatest(F.lit(0), *(F.coalesce(F.col(f"h{j}.line"), F.lit(0)) for j in range(1, k)), F.lit(0)), F.col(f"h{k}.title")) for k in range(1, 7)]
    return headed.select("path", "line", "text", "in_frontmatter", "in_fence", F.col("level").isNotNull().alias("is_heading"), F.concat_ws(" / ", *deeper).alias("section_path"))


def prose(lines: DataFrame) -> DataFrame:
    """Body lines outside of fences, inline code blanked."""
    return lines.where("not in_frontmatter and not in_fence").withColumn("text", mask_inline_code("text"))


def link_array(text: Column) -> Column:
    """The links and embeds of one line of prose, in order: position, is_embed, target, display_text."""
    whole = F.regexp_extract_all(mask_inline_code(text), F.lit(f"({WIKI_LINK})"), 1)

    def parts(link: Column, position: Column) -> Column:
        target = F.trim(F.regexp_replace(F.regexp_extract(link, r"\[\[([^\[\]|\\]+)", 1), r"#.*$", ""))
        display = F.when(link.contains("|"), F.regexp_extract(link, r"\\?\|([^\[\]]*)\]\]$", 1))
        return F.struct(position.alias("position"), (link.startswith("!") | target.rlike(IMAGE)).alias("is_embed"), target.alias("target"), display.alias("display_text"))

    return F.filter(F.transform(whole, parts), lambda x: x["target"] != "")


def width_of(display: Column) -> Column:
    """An embed's width; null where the display text is no number."""
    return F.when(display.rlike(r"^\d+$"), display.try_cast("int"))


def wiki_links(lines: DataFrame) -> DataFrame:
    """Every link and embed: path, line, position, is_embed, target, display_text, in_table, is_heading, section_path."""
    found = lines.where("not in_frontmatter and not in_fence").select("path", "line", F.col("text").rlike(r"^\s*\|").alias("in_table"), "is_heading", "section_path", F.explode(link_array(F.col("text"))).alias("x"))
    return found.select("path", "line", "x.position", "x.is_embed", "x.target", "x.display_text", "in_table", "is_heading", "section_path")


def links(lines: DataFrame) -> DataFrame:
    return wiki_links(lines).where("not is_embed").select("path", "line", "position", "target", "display_text", "in_table", "is_heading", "section_path")


def embeds(lines: DataFrame) -> DataFrame:
    """path, line, position, file, width (null where the display text is no number)."""
    return wiki_links(lines).where("is_embed").select("path", "line", "position", F.col("target").alias("file"), width_of(F.col("display_text")).alias("width"), "section_path")


def gallery_entries(lines: DataFrame) -> DataFrame:
    """Bullets of a cover embed and a bold link: path, line, file, width, target, description, section_path."""
    pattern = r"^\s*[-*]\s*!\[\[([^\[\]|\\]+)(?:\\?\|(\d+))?\]\]\s*\*\*\[\[([^\[\]|\\]+)(?:\\?\|[^\[\]]*)?\]\]\*\*\s*(?:[—–:-]+\s*)?(.*)$"
    got = lambda k: F.regexp_extract("text", pattern, k)
    return prose(lines).where(F.col("text").rlike(pattern)).select("path", "line", got(1).alias("file"), F.when(got(2) != "", got(2).cast("int")).alias("width"), got(3).alias("target"), got(4).alias("description"), "section_path")


def external_links(notes: DataFrame, lines: DataFrame) -> DataFrame:
    """URLs in front matter fields and inline links: source_path, line, origin, url."""
    fields = notes.select("path", F.explode(F.from_json(F.to_json("extra"), "map<string,string>")).alias("field", "url")).where(F.col("url").rlike(URL))
    inline = prose(lines).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(INLINE_LINK), 1)).alias("url"))
    return fields.select(F.col("path").alias("source_path"), F.lit(None).cast("int").alias("line"), F.lit("frontmatter").alias("origin"), "url").unionByName(inline.select(F.col("path").alias("source_path"), "line", F.lit("inline").alias("origin"), "url"))


def in_table(text: Column) -> Column:
    return text.rlike(r"^\s*\|")


def table_cells(text: Column) -> Column:
    """The cells of one row of a table; escaped pipes and those in links are no borders."""
    bare = F.regexp_replace(F.regexp_replace(mask_inline_code(text), r"\\\|", "\u0001"), r"\[\[[^\[\]]*\]\]", "link")
    return F.transform(F.split(F.regexp_replace(F.trim(bare), r"^\||\|$", ""), r"\|"), lambda x: F.trim(F.regexp_replace(x, "\u0001", "|")))


def raw_pipe(text: Column) -> Column:
    """Whether a link holds an unescaped pipe."""
    return F.regexp_replace(mask_inline_code(text), r"\\\|", "").rlike(r"\[\[[^\[\]]*\|[^\[\]]*\]\]")


def table_rows(lines: DataFrame) -> DataFrame:
    """Rows of Markdown tables: path, line, table_id (its first line), n_cells, cells, header_cells, raw_pipe (an unescaped
    pipe inside a link)."""
    rows = lines.where("not in_frontmatter and not in_fence").where(in_table(F.col("text"))).select("path", "line", "text", table_cells(F.col("text")).alias("cells"))
    order = Window.partitionBy("path").orderBy("line")
    first = F.coalesce(F.lag("line").over(order) != F.col("line") - 1, F.lit(True))
    head = rows.withColumn("first", first).withColumn("head", F.last(F.when(F.col("first"), F.struct("line", F.size("cells").alias("n"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return head.select("path", "line", F.col("head.line").alias("table_id"), F.size("cells").alias("n_cells"), "cells", F.col("head.n").alias("header_cells"), raw_pipe(F.col("text")).alias("raw_pipe"))


def chunks(notes: DataFrame, lines: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Sections as chunks: chunk_id, note_path, section_path, text, n_bytes. Sections with equal headings are chunks of their own.

    most_bytes: longer sections are cut by their content (functions.cuts), so that an edit changes few chunks and no others'
    ids: these come from the text then.
    """
    nth = F.count_if("is_heading").over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    body = lines.where("not in_frontmatter").withColumn("nth", nth).groupBy("path", "section_path", "nth").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    told = body.where(F.trim("text") != "")
    if most_bytes is None:
        return told.select(F.xxhash64("path", "section_path", "nth").alias("chunk_id"), F.col("path").alias("note_path"), "section_path", "text", F.octet_length("text").alias("n_bytes"))
    parts = told.select("path", "section_path", F.explode(cut_texts(F.col("text"), most_bytes)).alias("x"))
    return parts.select(F.xxhash64("path", "section_path", "x.text", "x.before").alias("chunk_id"), F.col("path").alias("note_path"), "section_path", "x.text", F.octet_length("x.text").alias("n_bytes"))


def variant_edges(notes: DataFrame, field: str, target: str | None = None, **attributes: str) -> DataFrame:
    """References by name in one front-matter field: source, source_kind, field, target, and attributes of list entries.

    field holds a name, a list of names, or a list of objects whose key `target` holds the name.
    """
    value = F.get_json_object(F.to_json("extra"), f"$.{field}")
    if target:
        entries = F.from_json(value, "array<map<string,string>>")
        rows = notes.select(F.col("name").alias("source"), F.col("note_kind").alias("source_kind"), F.explode(entries).alias("entry"))
        rows = rows.select("source", "source_kind", F.lit(field).alias("field"), F.element_at("entry", target).alias("target"), *(F.element_at("entry", key).alias(name) for name, key in attributes.items()))
    else:
        many = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
        rows = notes.select(F.col("name").alias("source"), F.col("note_kind").alias("source_kind"), F.lit(field).alias("field"), F.explode(many).alias("target"))
    return rows.where("target is not null and target != ''")


@dataclass
class NoteTables:
    """All tables of notes that are parsed already, from wherever they come."""

    notes: DataFrame
    lines: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.notes.sparkSession

    @property
    def links(self) -> DataFrame:
        return links(self.lines)

    @property
    def embeds(self) -> DataFrame:
        return embeds(self.lines)

    @property
    def table_rows(self) -> DataFrame:
        return table_rows(self.lines)


@dataclass
class Vault:
    """All tables of one notes folder. Nothing is read before a table is asked for; records and lines, which all others are
    made from, are kept once made, until close()."""

    spark: SparkSession
    root: str

    @cached_property
    def notes(self) -> DataFrame:
        return parse(scan(self.spark, self.root)).persist()

    @cached_property
    def lines(self) -> DataFrame:
        return note_lines(self.notes).persist()

    def close(self) -> None:
        for name in ("lines", "notes"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()

    @property
    def links(self) -> DataFrame:
        return links(self.lines)

    @property
    def embeds(self) -> DataFrame:
        return embeds(self.lines)

    @property
    def chunks(self) -> DataFrame:
        return chunks(self.notes, self.lines)

    @property
    def table_rows(self) -> DataFrame:
        return table_rows(self.lines)

    @property
    def attachments(self) -> DataFrame:
        return attachments(self.spark, self.root)

    @property
    def external_links(self) -> DataFrame:
        return external_links(self.notes, self.lines)


def field_value(path: str, kind: str = "string", record: Column | str = "extra") -> Column:
    """A dot-path in the untyped front matter; null where it is absent or doesn't cast."""
    return F.try_variant_get(F.col(record) if isinstance(record, str) else record, f"$.{path}", kind)


def has_field(path: str, record: str = "extra") -> Column:
    """Whether the key exists, even with null. A cast of an absent key is SQL null, of a null value it is a variant null."""
    return F.try_variant_get(F.col(record), f"$.{path}", "variant").isNotNull()


def has_value(path: str, record: str = "extra") -> Column:
    """Whether the key holds something: neither null, nor an empty string, nor an empty list."""
    text = F.get_json_object(F.to_json(record), f"$.{path}")
    return text.isNotNull() & ~text.isin("", "[]", "null")


