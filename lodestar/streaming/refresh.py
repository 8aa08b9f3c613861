"""Notes and ledgers as growing sources. The reference model refreshes on demand; here a stream does the same by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestar.functions.text import basename, folder
from lodestar.sources.ledger import parse_ledger, valid
from lodestar.sources.notes import below

NOTE_FILES = "path string, modificationTime timestamp, length long, content binary"
#: transformWithState keeps its state in RocksDB.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def note_stream(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """New and changed files as they come, as notes.scan gives them: notes.parse and all that follows take them batch by batch."""
    files = spark.readStream.format("binaryFile").schema(NOTE_FILES).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root)
    rows = files.select(below(root, F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"))
    return rows.select("path", basename("path", suffix).alias("name"), folder("path").alias("folder"), "mtime", "size", F.sha2("text", 256).alias("content_hash"), "text")


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    """Valid ledger rows of a folder of JSON-lines files, with time, file and file_pos (the line): the order of equal times."""
    files = spark.readStream.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("file_pos", "value")).withColumn("file_pos", F.col("file_pos").cast("long"))
    return valid(parse_ledger(lines)).withColumn("time", F.try_to_timestamp("ts"))


class Latest(StatefulProcessor):
    """Of each card the latest row by axis, and whether a fix was ever noted. A later row must have a greater ts to take an
    earlier one's place; rows that come together count in the order of ts, file and file_pos."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "audit_type string", "ts string, score double, pristine boolean")
        self.fixed = handle.getValueState("fixed", "was boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fixed = bool(self.fixed.exists() and self.fixed.get()[0])
        changed = {}
        batch = pd.concat(list(rows)).sort_values(["ts", "file", "file_pos"], kind="stable")
        for ts, axis, score, fix in zip(batch["ts"], batch["audit_type"], batch["score"], batch["fixes_applied"]):
            if ts is not None and axis is not None:
                known = self.rows.getValue((axis,))[0] if self.rows.containsKey((axis,)) else None
                if known is None or ts > known:
                    score = None if pd.isna(score) else float(score)
                    self.rows.updateValue((axis,), (ts, score, not fixed))
                    changed[axis] = (ts, score, not fixed)
            fixed = fixed or fix is True or fix == True  # noqa: E712
        self.fixed.update((fixed,))
        yield pd.DataFrame([(key[0], axis, *row) for axis, row in changed.items()], columns=["note", "audit_type", "ts", "score", "pristine"])

    def close(self) -> None:
        pass


def latest_rows(ledger: DataFrame) -> DataFrame:
    """note, audit_type, ts, score, pristine: an update for each card and axis whose latest row changed; pristine tells whether no
    earlier row of the card had fixes applied. State: one row for each card and axis. Needs STATE_STORE."""
    rows = ledger.where("note is not null").select("note", "audit_type", "ts", "score", "fixes_applied", "file", "file_pos")
    return rows.groupBy("note").transformWithStateInPandas(Latest(), "note string, audit_type string, ts string, score double, pristine boolean", "Update", "None")


def latest_scores(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """The greatest-ts score of each note and axis, as an aggregation whose state is one row a key and day."""
    newest = F.max(F.struct("ts", "score"))
    return rows.withWatermark("time", delay).groupBy(F.window("time", "1 day"), "note", "audit_type").agg(newest.alias("last")).select("window", "note", "audit_type", F.col("last.ts").alias("ts"), F.col("last.score").alias("score"))


def distinct_measurements(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """Repeats of one input hash within the watermark are dropped."""
    return rows.withWatermark("time", delay).dropDuplicatesWithinWatermark(["note", "audit_type", "content_hash"])


def run_batches(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Applies a function to each micro-batch of all files that are there, then stops; the next run goes on where it ended."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
