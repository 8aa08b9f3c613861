"""Chat formatting: typed content parts, a template whose turns read back exactly, and a loss mask.

A visitor flattens a message's parts in order: text is escaped, an image, audio or document part becomes a placeholder
with its number, and is recorded as an attachment with the tokens that it expands to.

    <s>[INST] role [/INST]\\n text <image:0>\\n</s>\\n

Text parts that follow each other are one text before anything is escaped, so that no marker arises where two meet. Control
strings inside texts and roles get one more backslash in front (and so does a control string that already has some), so that
reading back takes one away. A true marker never follows a backslash: a line end comes first, or a space. Each placeholder
brings its own space along, which reading back takes away with it.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<image:", "<audio:", "<document:")
_CONTROL = "|".join(map(re.escape, CONTROLS))
_ESCAPE, _UNESCAPE = re.compile(rf"(\\*)({_CONTROL})"), re.compile(rf"\\(\\*)({_CONTROL})")
OPEN, BODY, CLOSE = "<s>[INST] ", " [/INST]\n", "\n</s>\n"
MEDIA = ("image", "audio", "document")
#: A placeholder with its space. Texts can't hold one: there a backslash stands before the bracket.
PLACEHOLDER = re.compile(rf" <({'|'.join(MEDIA)}):(\d+)>")

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text) if "\\" in text else text


@dataclass
class TokenRates:
    """What a part expands to: an image by square patches, audio by second, a document by page."""

    patch: int = 14
    audio_per_second: float = 25.0
    document_per_page: int = 256


@dataclass
class PartVisitor:
    """Flattens the parts of a conversation's messages; numbers go on from message to message.

    attachments holds those of the latest message only, so that a conversation of any length needs little memory.
    """

    rates: TokenRates = field(default_factory=TokenRates)
    attachments: list[dict] = field(default_factory=list)
    count: int = 0
    tokens: int = 0

    def message(self, parts: list[dict] | None) -> str:
        self.attachments = []
        out: list[str] = []
        text: list[str] = []
        for part in parts or ():
            if part.get("kind") in MEDIA:
                out += [escape("".join(text)), self.visit(part)]
                text = []
            else:
                text.append(self.visit(part))
        return "".join([*out, escape("".join(text))])

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_text)(part)

    def visit_text(self, part: dict) -> str:
        """Texts, and parts of a kind that isn't known, as their text; message() escapes it."""
        return part.get("text") or ""

    def visit_image(self, part: dict) -> str:
        side = lambda n: max(1, math.ceil((n or 0) / self.rates.patch))
        return self.attach(part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> str:
        return self.attach(part, max(1, math.ceil((part.get("seconds") or 0) * self.rates.audio_per_second)))

    def visit_document(self, part: dict) -> str:
        return self.attach(part, max(1, part.get("pages") or 0) * self.rates.document_per_page)

    def attach(self, part: dict, tokens: int) -> str:
        number, self.count = self.count, self.count + 1
        self.attachments.append({"number": number, "kind": part["kind"], "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens
        return f" <{part['kind']}:{number}>"


def format_turn(role: str, body: str) -> str:
    """One turn; body is what the visitor made."""
    return f"{OPEN}{escape(role)}{BODY}{body}{CLOSE}"


def read_parts(body: str) -> list[str | tuple[str, int]]:
    """What a turn's body was made of: texts, unescaped, and attachments as (kind, number)."""
    found, at = [], 0
    for m in PLACEHOLDER.finditer(body):
        found += [unescape(body[at : m.start()]), (m[1], int(m[2]))]
        at = m.end()
    return [x for x in (*found, unescape(body[at:])) if x]


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text without attachments, and the span of the body in the formatted string, turn by turn."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        start = formatted.index(BODY, at)
        end = formatted.index(CLOSE, start)
        body = formatted[start + len(BODY) : end]
        yield unescape(formatted[at + len(OPEN) : start]), "".join(x for x in read_parts(body) if isinstance(x, str)), start + len(BODY), end
        at = end + len(CLOSE)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments long, expanded_tokens long"
TURNS = "conv_id long, turn long, position long, role string, formatted string, loss_from int, loss_to int, attachments array<struct<number:int,kind:string,ref:string,tokens:int>>"


def sorted_turns(messages: DataFrame) -> DataFrame:
    """Messages of a conversation together and in order: by turn, then role and content for equal turns."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("parts"))
    return rows.withColumn("tie", F.to_json("parts")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").drop("tie")


def _walk(batches: Iterator[pa.RecordBatch], rates: TokenRates) -> Iterator[tuple]:
    """Each message with its conversation's visitor, formatted; only one conversation's counters are held at a time."""
    now, visitor, position = object(), PartVisitor(rates), 0
    for batch in batches:
        for conv, turn, role, parts in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "parts"))):
            begins = conv != now
            if begins:
                now, visitor, position = conv, PartVisitor(rates), 0
            yield conv, turn, position, begins, role, format_turn(role, visitor.message(parts)), visitor
            position += 1


def format_turns(messages: DataFrame, learn: tuple[str, ...] = ("assistant",), rates: TokenRates | None = None) -> DataFrame:
    """One row a turn: its formatted text, the span under the loss mask (null for roles not learnt), its attachments.

    messages: conv_id, turn, role, parts (PARTS). Null parts, text or role: empty. Null conv_id: a conversation of its own;
    null turns come first. The formatted conversation is its turns' texts joined in order of position. Other columns are
    ignored; an empty table gives an empty result. A conversation is read as a sorted stream, never gathered.
    """
    rates = rates or TokenRates()
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("attachments", pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])))])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for conv, turn, position, _, role, text, visitor in _walk(batches, rates):
            a, b = next((a, b) for _, _, a, b in read_turns(text))
            rows.append((conv, turn, position, role, text, *((a, b) if role in learn else (None, None)), visitor.attachments))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    return sorted_turns(messages).mapInArrow(turns, TURNS)


def conversation_digests(messages: DataFrame, learn: tuple[str, ...] = ("assistant",), rates: TokenRates | None = None) -> DataFrame:
    """One row a conversation, read back from its formatted turns: DIGEST. The digests are folds over the sorted stream, so a
    conversation of any length needs one message's memory.

    Null parts, text or role: empty. Null conv_id: a conversation of its own. Repeated rows are turns of their own. Other
    columns are ignored; an empty table gives an empty result.
    """
    rates = rates or TokenRates()
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attachments", pa.int64()), ("expanded_tokens", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state = None

        def close() -> None:
            conv, n, turns, loss_n, loss, chars, visitor = state
            done.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, visitor.count, visitor.tokens))

        for conv, _, _, begins, _, formatted, visitor in _walk(batches, rates):
            if begins:
                if state:
                    close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, visitor]
            for role, text, _, _ in read_turns(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if role in learn:
                    state[3] += len(text)
                    state[4].update(text.encode())
            state[5] += len(formatted)
            if len(done) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), kinds)], schema=kinds)
                done = []
        if state:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), kinds)], schema=kinds)

    return sorted_turns(messages).mapInArrow(digests, DIGEST)


def text_parts(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as messages of one text part each."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def parse_parts(content: str) -> list[dict]:
    """A message's content as parts: a JSON list of parts, or else plain text."""
    try:
        parts = json.loads(content)
    except ValueError:
        parts = None
    return parts if isinstance(parts, list) and all(isinstance(x, dict) for x in parts) else [{"kind": "text", "text": content}]
