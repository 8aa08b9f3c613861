"""Quality rules by document, and by host: a host's rate of failures of each rule is shrunk towards that rule's empirical
beta prior, and the host's verdict joins back to its documents.

Two rules reject a document by themselves. All five count against its host: it goes as a whole where one of its shrunk rates
stands out from the fitted prior and most of its documents fail."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import raw, slices, utf8, written

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20
#: A host goes where a shrunk failure rate is above the prior's mean by OUTLIER of its standard deviations; at the least
#: where half of its documents fail, at the most where three of four do.
OUTLIER, LEAST_LIMIT, MOST_LIMIT = 4.0, 0.5, 0.75
#: The rules whose failures count against a host, and those that reject a document by themselves.
RULES, BASE = ("short", "repeats", "symbols", "dup_lines", "word_length"), ("short", "repeats")
#: More symbols than a tenth of the words; over three tenths of the lines repeated; words of such mean length. Scripts without
#: spaces have long words, so that no language fails as a whole.
MOST_SYMBOLS, MOST_DUP_LINES, MEAN_LENGTH = 0.1, 0.3, (2.0, 100.0)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = own[:n].copy()
    for k in range(1, width):
        h = (h ^ (h >> np.uint64(29))) * _BASE + own[k : n + k]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    return measure_lines(data)[:5]


def measure_lines(data: bytes) -> tuple[int, int, int, int, int, int]:
    """What measure() gives, and the number of lines with a word."""
    words = data.split()
    solid = b"".join(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(utf8(solid)), len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def document_rules(docs: DataFrame) -> DataFrame:
    """doc_id, host, the six counts, failed_* for each rule, base_failed for each row of docs (doc_id, text, source)."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    kinds = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((x, pa.int64()) for x in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                rows = [measure_lines(x) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host").cast(pa.string()), *(pa.array(x, pa.int64()) for x in zip(*rows))], schema=kinds)

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), raw("text").alias("text")).mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{x} long" for x in counts))
    words, mean = F.col("n_words"), F.try_divide(F.col("word_chars"), F.col("n_words"))
    failed = {
        "short": words < FEWEST_WORDS,
        "repeats": F.col("n_repeat_words") * 100 > words * MOST_REPEATED_PERCENT,
        "symbols": F.col("n_symbols") > words * MOST_SYMBOLS,
        "dup_lines": F.col("n_dup_lines") > F.col("n_lines") * MOST_DUP_LINES,
        "word_length": F.coalesce(~mean.between(*MEAN_LENGTH), F.lit(False)),
    }
    return measured.select("*", *(failed[x].alias(f"failed_{x}") for x in RULES), (failed["short"] | failed["repeats"]).alias("base_failed"))


def moments(rule: str) -> list[Column]:
    """Sums over hosts that a rule's prior is fitted from."""
    failed = F.col(f"failures_{rule}")
    return [F.sum(failed).alias(f"f_{rule}"), F.sum(failed * failed / F.col("documents")).alias(f"q_{rule}")]


def beta_prior(documents: int, hosts: int, failures: float, squares: float) -> tuple[float, float]:
    """Alpha and beta of hosts' failure rates, by moments weighted with documents; a weak prior where they don't vary."""
    if not documents:
        return 1.0, 1.0
    mean = failures / documents
    # what chance alone adds to the variance of a host's rate goes
    variance = squares / documents - mean * mean - mean * (1 - mean) * hosts / documents
    strength = mean * (1 - mean) / variance - 1 if variance > 1e-9 else 100.0
    strength = min(max(strength, 2.0), 1000.0)
    return max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)


def host_limit(alpha: float, beta: float) -> float:
    """The shrunk rate above which a host stands out from its prior."""
    total = alpha + beta
    spread = (alpha * beta / (total * total * (total + 1))) ** 0.5
    return min(max(alpha / total + OUTLIER * spread, LEAST_LIMIT), MOST_LIMIT)


def host_verdicts(rules: DataFrame) -> DataFrame:
    """A row for each host: host, documents, failures_* and rate_* (shrunk) by rule, shrunk_rate (the greatest), host_rejected.
    Null is a host of its own."""
    hosts = written(rules.groupBy("host").agg(F.count("*").alias("documents"), *(F.count_if(f"failed_{x}").alias(f"failures_{x}") for x in RULES)))
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("documents").alias("documents"), *(y for x in RULES for y in moments(x))).first()
    priors = {x: beta_prior(total.documents or 0, total.hosts, float(total[f"f_{x}"] or 0), float(total[f"q_{x}"] or 0)) for x in RULES}
    rate = {x: (F.col(f"failures_{x}") + a) / (F.col("documents") + a + b) for x, (a, b) in priors.items()}
    rejected = [rate[x] > host_limit(*priors[x]) for x in RULES]
    return hosts.select("*", *(rate[x].alias(f"rate_{x}") for x in RULES), F.greatest(*rate.values()).alias("shrunk_rate"), reduce(Column.__or__, rejected).alias("host_rejected"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    host, shrunk_rate, host_rejected. kept: neither the base rules nor the host's verdict reject it.

    Null text: no words, so it fails. Null source: one host. Repeated rows count and come back each; an empty table gives an
    empty result; other columns are ignored.
    """
    rules = written(document_rules(docs))
    verdicts = host_verdicts(rules).select(F.col("host").alias("of_host"), "shrunk_rate", "host_rejected")
    joined = rules.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host", "shrunk_rate", "host_rejected")


def quality_filter(docs: DataFrame) -> DataFrame:
    """docs without the rows that the base rules or their host's verdict reject; all columns as they were.

    Null, empty and blank texts go. Null sources are one host. Repeated rows stay or go together.
    """
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [measure((x or "").encode()) for x in batch.column(names.index("text")).to_pylist()]
            yield batch.filter(pa.array([n >= FEWEST_WORDS and 100 * r <= MOST_REPEATED_PERCENT * n for n, *_, r in counts], pa.bool_()))

    bad = host_verdicts(document_rules(docs)).where("host_rejected").select(F.col("host").alias("__host"))
    return docs.mapInArrow(run, docs.schema).join(bad, F.col("source").cast("string").eqNullSafe(F.col("__host")), "left_anti")
