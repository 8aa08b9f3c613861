"""Spelling variant grouping: words at one edit, found by a relational walk through a trie.

The trie is a table of edges (node, label, child), dealt out by node; chains without branches are one edge. States (word,
position, node, edits) are joined with it level by level: an exact step keeps the edits, a replaced or an inserted character
makes them one, and states that end at a word's node with one edit are neighbours. A deleted character is the same pair seen
from the other word.

One edit leaves either the first half of a word whole or the second. So each word starts at the node of its first half, and,
in a second trie of reversed words, at that of its second half: no state passes the crowded top of a trie, and a node's edges
are at most as many as there are letters, so that a level's rows grow with the words only. Nodes are told apart by a hash; two
that share one would only add candidates, and every pair is checked before it counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from xxhash import xxh64

from lodestar.llm.common import raw, slices, utf8, written

#: Fixed values of the contract: words have so many code points and occurrences; a run in every SLIPS-th place loses a letter;
#: a form is so many times as frequent.
LEAST_LENGTH, LEAST_COUNT, SLIPS, RATIO = 6, 5, 199, 5
RUN, OTHER = re.compile(r"[a-zÀ-ÿ]{6,}"), re.compile(r"[^a-zÀ-ÿ]")
#: So many words are counted in a task before they are handed on; so many characters are looked at in one go.
MOST_WORDS, PIECE = 200_000, 1 << 22
#: No node above this depth is needed: halves of words are as long at least.
TOP = LEAST_LENGTH // 2


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in parts that don't cut a run of letters."""
    start = 0
    while start < len(text):
        end = start + size
        cut = OTHER.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def runs_of(doc_id: int | None, data: bytes) -> Iterator[tuple[str, int]]:
    """Runs of letters in one text, A to Z lower-cased, and how often; those whose checksum says so without one letter."""
    base = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    base = zlib.crc32(b":", base)
    # bytes.lower() changes A to Z alone
    for piece in pieces(utf8(data.lower())):
        for run, n in Counter(RUN.findall(piece)).items():
            h = zlib.crc32(run.encode(), base)
            if h % SLIPS == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            yield run, n


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: words of LEAST_LENGTH code points that all texts together have LEAST_COUNT times or more."""
    kinds = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=kinds)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    for word, n in runs_of(doc_id, data):
                        if len(word) >= LEAST_LENGTH:
                            total[word] += n
                    if len(total) > MOST_WORDS:
                        yield flush()
                        total.clear()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw("text").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- the trie


def prefixes(words: DataFrame) -> DataFrame:
    """spelt, size, pos, node, next, start for each prefix of TOP letters or more of each word and each word read backwards:
    its hash, the letter behind it (0 at the word's end), and whether the walk of this word starts there."""
    kinds = pa.schema([("spelt", pa.string()), ("back", pa.bool_()), ("size", pa.int32()), ("pos", pa.int32()), ("node", pa.int64()), ("next", pa.int32()), ("start", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word in batch.column("word").to_pylist():
                size = len(word)
                for back in (False, True):
                    spelt = word[::-1] if back else word
                    start = size - size // 2 if back else size // 2
                    hashed = xxh64(spelt[:TOP].encode(), seed=int(back))
                    for pos in range(TOP, size + 1):
                        node = hashed.intdigest()
                        rows.append((spelt, back, size, pos, node - (1 << 64) if node >> 63 else node, ord(spelt[pos]) if pos < size else 0, pos == start))
                        if pos < size:
                            hashed.update(spelt[pos].encode())
                if len(rows) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    return words.select("word").mapInArrow(run, "spelt string, back boolean, size int, pos int, node long, next int, start boolean")


def chains(steps: DataFrame) -> DataFrame:
    """Of each word's prefixes those that are nodes: where words branch, end or start. below, shortest, longest: how many words
    have the prefix, and their lengths; follow: a bit for each letter that comes next (letters may share one)."""
    follow = F.bit_or(F.expr("if(next > 0, shiftleft(1L, next % 64), 0L)"))
    nodes = steps.groupBy("node").agg(
        F.min("next").alias("lo"), F.max("next").alias("hi"), F.max("start").alias("some"), F.count("*").alias("below"), F.min("size").alias("shortest"), F.max("size").alias("longest"), follow.alias("follow")
    )
    nodes = nodes.where("lo = 0 or lo < hi or some").select("node", "below", "shortest", "longest", "follow")
    return steps.drop("next").join(nodes, "node")


def trie_edges(chain: DataFrame) -> DataFrame:
    """node, label, child, word (the word that ends at the child), below, shortest, longest, follow (of the child)."""
    along = Window.partitionBy("back", "spelt").orderBy("pos")
    after = F.lead(F.struct("pos", "node", "below", "shortest", "longest", "follow")).over(along)
    rows = chain.select("node", "back", "spelt", "size", "pos", after.alias("x")).where("x is not null")
    label = F.substring("spelt", F.col("pos") + 1, F.col("x.pos") - F.col("pos"))
    ends = F.when(F.col("x.pos") == F.col("size"), F.when(F.col("back"), F.reverse("spelt")).otherwise(F.col("spelt")))
    child = rows.select("node", label.alias("label"), F.col("x.node").alias("child"), ends.alias("word"), "x.below", "x.shortest", "x.longest", "x.follow")
    return child.groupBy("node", "label", "child").agg(F.max("word").alias("word"), F.max("below").alias("below"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"), F.bit_or("follow").alias("follow"))


def one_level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States behind each edge that they can pass: spelt, back, pos, node, edits, size (that the other word must have; with no
    edit yet that of the own one), word where one ends, and whether it goes on."""
    piece = lambda n: F.substring("spelt", F.col("pos") + 1, n)
    n = F.char_length("label")
    same, shorter = piece(n), piece(n - 1)
    option = lambda when, pos, edits, size: F.when(when, F.struct(pos.alias("pos"), F.lit(edits).alias("edits"), size.alias("size")))
    fresh, size = F.col("edits") == 0, F.col("size")
    # of one letter any other is an edit
    edit = lambda own, length: (F.char_length(own) == length) & F.when(n == 1, own != F.col("label")).otherwise(F.levenshtein(own, F.col("label"), 1) == 1)
    options = F.array_compact(F.array(
        F.when(same == F.col("label"), F.struct((F.col("pos") + n).alias("pos"), F.col("edits").alias("edits"), size.alias("size"))),
        option(fresh & edit(same, n), F.col("pos") + n, 1, size), option(fresh & edit(shorter, n - 1), F.col("pos") + n - 1, 1, size + 1),
    ))
    # what no word below can end is left out
    met = states.join(edges, "node").where((F.col("shortest") <= size + F.when(fresh, 1).otherwise(0)) & (F.col("longest") >= size))
    passed = met.select("spelt", "back", "child", "word", "below", "shortest", "longest", "follow", F.explode(options).alias("x")).where(F.expr("shortest <= x.size + 1 - x.edits and longest >= x.size"))
    own = F.char_length("spelt")
    passed = passed.withColumn("ends", F.col("x.pos") == own)
    # with its edit made, a state goes on only where the word's next letter does
    goes_on = F.expr("x.edits = 0 or (not ends and (follow & shiftleft(1L, ascii(substring(spelt, x.pos + 1, 1)) % 64)) != 0)")
    passed = passed.where(goes_on | (F.col("ends") & F.col("word").isNotNull())).withColumn("goes_on", goes_on & (F.col("below") > 1))
    ends = F.when((F.col("x.edits") == 1) & F.col("ends"), F.col("word"))
    rows = passed.select("spelt", "back", F.col("child").alias("node"), "x.pos", "x.edits", "x.size", ends.alias("word"), "goes_on")
    # nothing lies behind a node of one word
    return rows.where("word is not null or goes_on")


def near_pairs(words: DataFrame) -> DataFrame:
    """words: word, distinct. a, b for each two words that one inserted, deleted or replaced code point tells apart, both ways.

    Each level is a written table: a lost executor costs one level. There are as many levels as nodes behind a word's start.
    """
    steps = written(prefixes(words))
    chain = written(chains(steps))
    edges = written(trie_edges(chain))
    states = chain.where("start").select("spelt", "back", "pos", "node", F.lit(0).alias("edits"), "size")
    found = []
    while True:
        level = written(one_level(states, edges))
        ends = level.where("word is not null")
        found.append(ends.select(F.when(F.col("back"), F.reverse("spelt")).otherwise(F.col("spelt")).alias("a"), F.col("word").alias("b")))
        states = level.where("goes_on").select("spelt", "back", "pos", "node", "edits", "size")
        if states.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.where(F.levenshtein("a", "b", 1) == 1)
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


# ---- forms


def _roots(forms: DataFrame) -> DataFrame:
    """forms: word, form, whose chains end. word, root: each chain's end, by pointers that double their reach each round."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        behind = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(now.join(behind, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words: word, n. word, form, root, n, n_near, form_n. A word's form is its most frequent near word (ties: the first in
    code-point order) if that is `ratio` times as frequent; root: the end of its forms' chain, or itself."""
    pairs = near_pairs(words)
    of = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    # a word has few near words: as many as letters fit in its places
    near = pairs.join(of, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("minus"), "b")).alias("x"))
    rows = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    good: Column = -F.col("x.minus") >= ratio * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("x.b")).alias("form"), F.when(good, -F.col("x.minus")).alias("form_n")))
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row for each word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null doc_id counts as empty in a run's checksum. Repeated rows count each time. Texts
    and runs are taken whole, however long. An empty table: an empty result. Other columns are ignored.
    """
    return grouped(written(counted_words(docs)))
