"""The persisted index: versions of Parquet tables, of which a refresh writes only what changed.

A version is a folder of its own. Whole versions hold all notes, deltas the changed ones, and in `manifest` what happened to each
path since the version before: `added`, `changed`, `removed`, or `touched` (another time, the same content). Readers merge: a
row counts unless a later version's manifest names its path. One row in `meta`, added last, makes a version count, so that a
failure on the way leaves the index as it was and readers of earlier versions keep theirs. After MOST_DELTAS deltas the merged
tables are written as a whole version again.

A refresh lists all files without opening any; only those whose time or size differ from the manifest are read and hashed, and
only those whose content differs are parsed. A change that keeps both time and size needs full=True.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.layout import stored
from lodestar.sources import notes as N

INDEX_VERSION = 3
TABLES = ("notes", "lines", "links", "embeds", "chunks", "table_rows")
MOST_DELTAS = 8
#: Up to so many files are opened by name; beyond, all are read and the others left out.
MOST_NAMED = 10_000
META = "version int, seq long, built timestamp, whole boolean, notes long"
MANIFEST = ("path", "mtime", "size", "content_hash")
SETTLED = "change != 'touched'"


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """keys and change (added, removed, changed, kept): a full outer join of two listings, compared by version columns."""
    old = before.select(*keys, F.struct(*version).alias("__old")) if version else before.select(*keys).distinct().withColumn("__old", F.lit(True))
    new = after.select(*keys, F.struct(*version).alias("__new")) if version else after.select(*keys).distinct().withColumn("__new", F.lit(True))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "kept").otherwise("changed")
    return old.join(new, keys, "full_outer").select(*keys, change.alias("change"))


def tables_of(notes: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    return {"notes": notes, "lines": lines, "links": N.links(lines), "embeds": N.embeds(lines), "chunks": N.chunks(notes, lines), "table_rows": N.table_rows(lines)}


def path_of(table: str) -> str:
    return "note_path" if table == "chunks" else "path"


# ---- versions


def versions(spark: SparkSession, path: str) -> list[Row]:
    """The latest whole version and the deltas after it, in order; none where the index is missing or of another layout."""
    try:
        # one short row for each version
        meta = spark.read.schema(META).parquet(f"{path}/meta").orderBy("seq").collect()
    except AnalysisException:
        return []
    last_whole = max((k for k, x in enumerate(meta) if x.whole), default=len(meta))
    return [] if any(x.version != INDEX_VERSION for x in meta[last_whole:]) else meta[last_whole:]


def _folder(path: str, version: Row, table: str) -> str:
    return f"{path}/v{version.seq}/{table}"


def _without_later(rows: list[DataFrame], manifests: list[DataFrame], name: str) -> DataFrame:
    """Rows of all versions that no later manifest names. Deltas are small beside what they are taken from."""
    out = None
    for k, own in enumerate(rows):
        for later in manifests[k + 1 :]:
            own = own.join(later.select(F.col("path").alias(name)), name, "left_anti")
        out = own if out is None else out.unionByName(own)
    return out


def merged(spark: SparkSession, path: str, chain: list[Row], table: str) -> DataFrame:
    """One table of the index, as the latest version has it."""
    manifests = [spark.read.parquet(_folder(path, x, "manifest")).where(SETTLED) for x in chain]
    return _without_later([spark.read.parquet(_folder(path, x, table)) for x in chain], manifests, path_of(table))


def live_manifest(spark: SparkSession, path: str, chain: list[Row]) -> DataFrame:
    """path, mtime, size, content_hash of each note that the index has."""
    manifests = [spark.read.parquet(_folder(path, x, "manifest")) for x in chain]
    return _without_later(manifests, manifests, "path").where("change != 'removed'").select(*MANIFEST)


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The latest tables; none where the index is missing or of another layout, so that it is built anew."""
    chain = versions(spark, path)
    return {name: merged(spark, path, chain, name) for name in TABLES} if chain else None


def write_version(spark: SparkSession, path: str, seq: int, tables: dict[str, DataFrame], whole: bool, notes: int | None = None) -> int:
    """A version's tables and manifest, and last the row that makes it count. notes: how many the index has now."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{seq}/{name}")
    notes = spark.read.parquet(f"{path}/v{seq}/notes").count() if notes is None else notes
    row = spark.range(1).select(F.lit(INDEX_VERSION).alias("version"), F.lit(seq).cast("long").alias("seq"), F.current_timestamp().alias("built"), F.lit(whole).alias("whole"), F.lit(notes).cast("long").alias("notes"))
    row.write.mode("append").parquet(f"{path}/meta")
    return notes


def _parsed(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of scanned files; records and lines, which the others are made from, are made once."""
    notes = stored(N.parse(files))
    return tables_of(notes, stored(N.note_lines(notes)))


def compact(spark: SparkSession, path: str) -> None:
    """The merged tables as a whole version."""
    chain = versions(spark, path)
    tables = {name: merged(spark, path, chain, name) for name in TABLES}
    manifest = live_manifest(spark, path, chain).withColumn("change", F.lit("added"))
    write_version(spark, path, chain[-1].seq + 1, {**tables, "manifest": manifest}, True)


# ---- refreshing

#: Gives scanned files (as notes.scan has them) of the paths in a table, or of all for None.
Reader = Callable[[DataFrame | None], DataFrame]


def suspects(known: DataFrame, listing: DataFrame) -> DataFrame:
    """path, was (content hash or null), there, mtime, size: paths that are new, gone, or of another time or size."""
    new = listing.select("path", F.col("mtime").alias("now"), F.col("size").alias("bytes"))
    both = known.join(new, "path", "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("now")) & F.col("size").eqNullSafe(F.col("bytes")) & F.col("content_hash").isNotNull() & F.col("bytes").isNotNull()
    return both.where(~same).select("path", F.col("content_hash").alias("was"), F.col("bytes").isNotNull().alias("there"), F.col("now").alias("mtime"), F.col("bytes").alias("size"))


def refresh(spark: SparkSession, path: str, listing: DataFrame, read: Reader, full: bool = False, most_deltas: int = MOST_DELTAS) -> dict[str, int]:
    """Brings the index at path up to a listing (path, mtime, size) and counts what changed: added, changed, removed, touched, kept.

    A listing's sizes must not be null. An index that is missing or of another layout is built from all files.
    """
    chain = [] if full else versions(spark, path)
    if not chain:
        old = versions(spark, path)
        tables = _parsed(read(None))
        manifest = tables["notes"].select(*MANIFEST, F.lit("added").alias("change"))
        return {"added": write_version(spark, path, old[-1].seq + 1 if old else int(time.time() * 1000), {**tables, "manifest": manifest}, True)}
    odd = stored(suspects(live_manifest(spark, path, chain), listing))
    seen = stored(read(odd.where("there").select("path")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("was") == F.col("content_hash"), "touched").otherwise("changed")
    found = seen.select("path", "content_hash").join(odd.where("there"), "path").select("path", "mtime", "size", "content_hash", change.alias("change"))
    gone = odd.where("not there").select("path", "mtime", "size", F.col("was").alias("content_hash"), F.lit("removed").alias("change"))
    manifest = stored(found.unionByName(gone))
    counts = {x.change: x["count"] for x in manifest.groupBy("change").count().collect()}
    n = chain[-1].notes + counts.get("added", 0) - counts.get("removed", 0)
    if counts:
        tables = _parsed(seen.join(manifest.where("change in ('added', 'changed')").select("path"), "path", "left_semi"))
        write_version(spark, path, chain[-1].seq + 1, {**tables, "manifest": manifest}, False, n)
        if len(chain) >= most_deltas:
            compact(spark, path)
    counts["kept"] = n - counts.get("added", 0) - counts.get("changed", 0) - counts.get("touched", 0)
    return {k: v for k, v in counts.items() if v}


def named_files(spark: SparkSession, root: str, files: DataFrame) -> Reader:
    """Reads by name what is asked for; files: path, file (its full name)."""

    def read(paths: DataFrame | None) -> DataFrame:
        if paths is None:
            return N.scan(spark, root)
        wanted = [x.file for x in files.join(paths, "path").select("file").limit(MOST_NAMED + 1).collect()]
        if len(wanted) > MOST_NAMED:
            return N.scan(spark, root).join(paths, "path", "left_semi")
        # a name is no pattern
        literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", x) for x in wanted]
        return N.scan(spark, root, files=literal) if literal else N.scan(spark, root).limit(0)

    return read


def reindex(spark: SparkSession, root: str, path: str, full: bool = False) -> dict:
    """Builds or refreshes the index of a folder at path; {indexed, timeMs, changes}."""
    began = time.time()
    files = N.listing(spark, root)
    changes = refresh(spark, path, files, named_files(spark, root, files), full)
    return {"indexed": versions(spark, path)[-1].notes, "timeMs": round((time.time() - began) * 1000), "changes": changes}
