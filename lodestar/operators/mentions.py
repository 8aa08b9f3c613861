"""Mentions of many terms in one narrow pass over lines: an Aho-Corasick automaton in each task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Terms that one automaton takes: some tens of MB in a task.
MOST_TERMS = 100_000


def is_single(term: str) -> bool:
    """A term of one word is a word of a line; others are literal text in it, between what is neither letter, digit nor _."""
    return term.isalnum()


def automaton(terms: list[Row]):
    """terms: target, term. Of the lower-cased texts; each has the places of its terms in the list."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for k, x in enumerate(terms):
        if x.term and any(c.isalnum() for c in x.term):
            places.setdefault(x.term.lower(), []).append(k)
    found = ahocorasick.Automaton()
    for text, own in places.items():
        found.add_word(text, (len(text), is_single(text), own))
    if places:
        found.make_automaton()
    return found if places else None


def mentioned(found, text: str) -> list[int]:
    """The places of the terms that a line mentions as whole words, each once."""
    low, out = text.lower(), set()
    for last, (length, single, own) in found.iter(low):
        first = last - length + 1
        before, after = low[first - 1] if first else " ", low[last + 1] if last + 1 < len(low) else " "
        if not (before.isalnum() or after.isalnum() or not single and "_" in (before, after)):
            out.update(own)
    return sorted(out)


def few_terms(terms: DataFrame) -> list[Row] | None:
    """The terms, or none if one automaton can't take them."""
    rows = terms.select("target", "term").where("term is not null").distinct().limit(MOST_TERMS + 1).collect()
    return rows if len(rows) <= MOST_TERMS else None


def mentions(lines: DataFrame, rows: list[Row], keys: list[str], terms: DataFrame) -> DataFrame:
    """keys, target, term for each row of lines (keys, text) and each of its terms. No exchange; texts stay where they are."""
    kinds = [*(lines.schema[k] for k in keys), *(StructField(k, terms.schema[k].dataType) for k in ("target", "term"))]
    targets, names = [x.target for x in rows], [x.term for x in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(rows)
        for batch in batches if found else ():
            at, of = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = mentioned(found, text) if text else ()
                at += [k] * len(own)
                of += own
            if at:
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in keys), pa.array([targets[x] for x in of]), pa.array([names[x] for x in of])], names=[*keys, "target", "term"])

    return lines.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, StructType(kinds))
