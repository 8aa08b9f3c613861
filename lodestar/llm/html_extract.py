"""HTML extraction by the maximum-scoring subsequence.

Words score by the element that they stand in and tags score negative, with weights learnt from labelled pages: pages whose
markup names their article. Class names, ids and roles have weights too: words of their elements inside and outside of
articles. One linear scan finds the contiguous region of highest score; its blocks, without the parts that are boilerplate
by their element or their marks' weight, are the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import raw, slices, utf8, written

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']++|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\s(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements that are boilerplate wherever they stand, and those that are unless an article holds them.
BOILER = {
    "nav", "aside", "form", "menu", "button", "select", "option", "input", "dialog", "head", "template", "svg", "canvas", "object", "audio", "video",
    "footer", "fieldset", "datalist", "search", *RAW,
}
BOILER_OUTSIDE = {"header"}
#: Parts of class names, ids and roles that name boilerplate, and such as say nothing of an element's content.
BOILER_WORDS = re.compile(
    r"ads?|advert\w*|adbox|banners?|promos?|promotions?|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletters?|subscribe\w*|subscription|"
    r"signup|login|social|share|sharing|related|recommend\w*|sidebars?|widgets?|menus?|nav\w*|breadcrumbs?|toc|pager|pagination|footer|masthead|teasers?|"
    r"comments?|reply|replies|respond|discuss|discussions?|disqus|search\w*|skip|toolbar|complementary|contentinfo"
)
NEUTRAL_WORDS = set(
    """area bar block body bottom box btn button buttons card cards center class col column container content cta entry feed field footer form global group head header icon icons id inner item items
    js large layout left link links list lists main media mobile module nested one outer page pages panel placeholder policy post posts primary right row secondary section side site small story stories
    sub tab tabs text thread three title tools top two ul unit user view widget wide wrap wrapper""".split()
)
#: With one of these in front a mark tells of the page's layout, not of what its element is.
LAYOUT_MARK = re.compile(r"(?:with|has|no|without)[_-]")
PARTS = re.compile(r"[a-z]+")
#: A mark that doesn't name boilerplate counts as such where its weight, the log-odds that its words are content, is below this.
#: Up to so many such marks are sent to all tasks; where a crawl has more, pages are joined with their own.
MARK_LIMIT, MARK_PRIOR, MOST_SENT_MARKS = -2.0, (20.0, 5.0), 50_000
#: So many keys are counted in a task before they are handed on.
MOST_KEYS = 100_000
#: Words in the document before any page is counted: inside and outside of articles, by kind of element.
PRIOR = {"boiler": (0.5, 30.0), "link": (3.0, 6.0), "text": (20.0, 5.0), "other": (6.0, 5.0)}
#: Boilerplate elements are left out of a region, so they count little against going on behind them.
MOST_WEIGHT, TAG_PRIOR, LEFT_OUT = 4.0, 0.3, 0.25
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_PARAGRAPH = {"p", "div", "ul", "ol", "article", "section", "footer", "aside", "nav", "header", "h1", "h2", "h3", "table", "form", "blockquote"}
KNOWN = INLINE | BOILER | VOID | set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header address center details summary".split()
)


class Segment:
    """A run of text or a tag. key: the kind of element around a text, or the tag's name; inside: whether an article holds it."""

    __slots__ = ("text", "key", "inside", "breaks", "boiler")

    def __init__(self, text: str | None, key: str, inside: bool, breaks: bool, boiler: bool) -> None:
        self.text, self.key, self.inside, self.breaks, self.boiler = text, key, inside, breaks, boiler


def named_boiler(mark: str) -> bool:
    """Whether a mark names boilerplate: all its parts do, or say nothing, and one does."""
    parts = PARTS.findall(mark)
    return not LAYOUT_MARK.match(mark) and any(map(BOILER_WORDS.fullmatch, parts)) and all(x in NEUTRAL_WORDS or BOILER_WORDS.fullmatch(x) for x in parts)


def marks_of(token: str) -> list[str]:
    return [x for found in MARKS.findall(token) for x in "".join(found).lower().split()] if "=" in token else []


class Open:
    """An open element. words: of its text inside and outside of articles."""

    __slots__ = ("name", "boiler", "inside", "block", "marks", "words")

    def __init__(self, name: str, boiler: bool, inside: bool, block: str, marks: list[str]) -> None:
        self.name, self.boiler, self.inside, self.block, self.marks, self.words = name, boiler, inside, block, marks, [0, 0]


def segments(page: str, is_boiler: Callable[[str], bool] = named_boiler, counted: dict | None = None) -> list[Segment]:
    """Texts and tags in order. counted: takes in the words of each mark's elements, inside and outside of articles.

    Every element is opened and closed once, so the time is linear in the page, however deep it nests.
    """
    out: list[Segment] = []
    stack: list[Open] = []
    open_names: Counter[str] = Counter()
    #: Positions in the stack of elements that aren't inline.
    block_at: list[int] = []
    bottom = Open("", False, False, "body", [])
    at, end = 0, len(page)

    def pop() -> Open:
        gone = stack.pop()
        open_names[gone.name] -= 1
        if block_at and block_at[-1] == len(stack):
            block_at.pop()
        if counted is not None:
            above = (stack[-1] if stack else bottom).words
            for k in (0, 1):
                above[k] += gone.words[k]
            for mark in gone.marks:
                own = counted.setdefault(("mark", mark), [0, 0])
                own[0] += gone.words[0]
                own[1] += gone.words[1]
        return gone

    while at < end:
        m = TOKEN.match(page, at)
        token, at = m[0], m.end()
        now = stack[-1] if stack else bottom
        if token[0] != "<" or token == "<":
            linked = any(x.name == "a" for x in stack[-4:])
            key = "boiler" if now.boiler else ("link:" if linked else "text:") + (now.block if now.block in KNOWN else "other")
            out.append(Segment(token, key, now.inside, False, now.boiler))
            if counted is not None:
                now.words[not now.inside] += len(token.split())
            continue
        named = NAME.match(token)
        if not named:
            continue
        name = named[1].lower()
        known = name if name in KNOWN else "other"
        if token[1] == "/":
            if open_names[name]:
                while pop().name != name:
                    pass
            elif name != "p":
                continue
            now = stack[-1] if stack else bottom
            out.append(Segment(None, known, now.inside, name not in INLINE, now.boiler))
            continue
        if name in ENDS_PARAGRAPH and block_at and stack[block_at[-1]].name == "p":
            # such an element ends an open paragraph, with what is open in it
            for _ in range(len(stack) - block_at[-1]):
                pop()
            now = stack[-1] if stack else bottom
        marks = marks_of(token)
        # marks of a heading inside an article tell of its section's name
        judged = [] if name in ("html", "body", "main") or now.inside and name in HEADINGS else marks
        own = name in BOILER or name in BOILER_OUTSIDE and not now.inside or any(map(is_boiler, judged))
        # an article inside of comments or teasers, or marked as one, is none
        within = now.inside or name == "article" and not own and not now.boiler
        out.append(Segment(None, known, within, name not in INLINE, now.boiler or own))
        if name in RAW:
            closing = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
        elif name not in VOID and not token.endswith("/>"):
            if name not in INLINE:
                block_at.append(len(stack))
            stack.append(Open(name, now.boiler or own, within, now.block if name in INLINE else name, marks if counted is not None else []))
            open_names[name] += 1
    while counted is not None and stack:
        pop()
    return out


def counts(page: str) -> dict[tuple[str, str], list[int]]:
    """Of a labelled page, words by key and by mark and tags by name, inside and outside its article; nothing for other pages."""
    found: dict[tuple[str, str], list[int]] = {}
    parts = segments(page, counted=found)
    if not any(x.inside for x in parts):
        return {}
    for x in parts:
        own = found.setdefault(("tag", x.key) if x.text is None else ("word", x.key), [0, 0])
        own[not x.inside] += 1 if x.text is None else len(x.text.split())
    return found


class Weights:
    def __init__(self, counted: dict[tuple[str, str], tuple[float, float]]) -> None:
        self.counted = counted
        self.words: dict[str, float] = {}
        self.tags: dict[str, float] = {}

    def word(self, key: str) -> float:
        """Log-odds that a word of this kind is content, with a prior's counts."""
        if key not in self.words:
            kind, _, block = key.partition(":")
            a, b = PRIOR["other" if kind == "text" and block in ("other", "body", "div", "td", "span") else kind]
            x, y = self.counted.get(("word", key), (0.0, 0.0))
            self.words[key] = max(-MOST_WEIGHT, min(MOST_WEIGHT, math.log((x + a) / (y + b))))
        return self.words[key]

    def tag(self, name: str) -> float:
        """Never positive: a tag that stands outside of articles more often costs more."""
        if name not in self.tags:
            x, y = self.counted.get(("tag", name), (0.0, 0.0))
            self.tags[name] = -TAG_PRIOR * (1 + (y + 1) / (x + y + 2))
        return self.tags[name]


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the highest sum, as [from, to); empty if no score is positive. The first of equal ones."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, region = total, (start, k + 1)
    return region


def main_text(page: str, weights: Weights, boiler_marks: Container[str] = ()) -> str:
    """boiler_marks: marks that count as boilerplate by their weight, of this page at least."""
    parts = segments(page, lambda mark: mark in boiler_marks or named_boiler(mark))
    scores = [(weights.tag(x.key) if x.text is None else weights.word(x.key) * len(x.text.split())) * (LEFT_OUT if x.boiler else 1) for x in parts]
    a, b = best_region(scores)
    blocks, now = [], []
    for x in parts[a:b]:
        if x.breaks:
            blocks.append("".join(now))
            now = []
        if x.text is not None and not x.boiler:
            now.append(x.text)
    blocks.append("".join(now))
    return " ".join(y for x in blocks if (y := " ".join(html.unescape(x).split())))


def learned_weights(pages: DataFrame) -> tuple[Weights, DataFrame]:
    """Counts of all labelled pages, summed in Spark. To the driver comes the fixed set of keys; a table holds each mark whose
    weight makes it boilerplate."""
    kinds = pa.schema([("kind", pa.string()), ("key", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])
    batch_of = lambda total: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*((*k, *v) for k, v in total.items())), kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for page in batch.column("html").to_pylist():
                for key, (x, y) in counts(utf8(page)).items():
                    own = total.setdefault(key, [0, 0])
                    own[0] += x
                    own[1] += y
                if len(total) > MOST_KEYS:
                    yield batch_of(total)
                    total = {}
        if total:
            yield batch_of(total)

    labelled = pages.where(F.lower("html").contains("<article")).select(raw("html").alias("html"))
    summed = written(labelled.mapInArrow(run, "kind string, key string, inside long, outside long").groupBy("kind", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")))
    fixed = summed.where("kind != 'mark'").collect()
    inside, outside = MARK_PRIOR
    marks = summed.where((F.col("kind") == "mark") & (F.log((F.col("inside") + inside) / (F.col("outside") + outside)) < MARK_LIMIT)).select(F.col("key").alias("mark"))
    return Weights({(x.kind, x.key): (float(x.inside), float(x.outside)) for x in fixed}), marks


def with_own_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (with html) and `boiler_marks`: those of the table that the page has. Marks meet pages' distinct marks; a page's own
    are few, and equal pages meet them once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                own = [sorted({x for token in TOKEN.findall(utf8(page)) if token[:1] == "<" for x in marks_of(token)}) for page in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(own, pa.list_(pa.string()))], names=["page", "own"])

    named = rows.withColumn("page", F.sha2("html", 256))
    of_page = named.select("page", "html").dropDuplicates(["page"]).mapInArrow(found, "page string, own array<string>").select("page", F.explode("own").alias("mark"))
    met = of_page.join(marks, "mark").groupBy("page").agg(F.collect_set("mark").alias("boiler_marks"))
    return named.join(met, "page", "left").drop("page")


def html_extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, and pages without content: empty text. Repeated rows give repeated rows, an empty table an empty
    result; other columns are ignored. Without labelled pages the prior's weights hold.
    """
    weights, marks = learned_weights(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw("html").alias("html"))
    sent = marks.count() <= MOST_SENT_MARKS
    rows = rows.withColumn("boiler_marks", F.lit(None).cast("array<string>")) if sent else with_own_marks(rows, marks)
    everywhere = frozenset(x.mark for x in marks.collect()) if sent else frozenset()
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                texts = [main_text(utf8(x), weights, everywhere if own is None else set(own)) for x, own in zip(batch.column("html").to_pylist(), batch.column("boiler_marks").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string())], schema=kinds)

    out = rows.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
