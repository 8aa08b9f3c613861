"""SentencePiece encoding and decoding with offsets.

A text is normalised by the model's own rules: at each position the longest prefix in the compiled character map is
replaced, spaces become the piece mark, a dummy prefix goes in front. The source byte of every normalised byte is kept, so
each piece projects to a span of the original bytes. Ids and decoded texts are the sentencepiece library's own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import raw, slices, utf8

MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()
BATCH_BYTES = 2 << 20


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes, with null-terminated replacements behind it."""

    def __init__(self, blob: bytes) -> None:
        self.units: np.ndarray = np.zeros(0, np.uint32)
        self.text = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.text = blob[4 + size :]

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data[at:] starts with."""
        if not len(self.units):
            return None
        found, node = None, 0
        unit = int(self.units[0])
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = int(self.units[node])
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = int(self.units[node]) & 0x7FFFFFFF
                found = k + 1 - at, self.text[value : self.text.index(b"\0", value)]
        return found


@dataclass
class Normalizer:
    charmap: CharMap
    dummy_prefix: bool = True
    remove_extra_whitespaces: bool = False
    escape_whitespaces: bool = True

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them its source byte's position, and where the last one's source ends."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if len(self.charmap.units) or self.remove_extra_whitespaces:
            norm, source, end = self._mapped(data)
        else:
            norm, source, end = np.frombuffer(data, np.uint8), np.arange(len(data)), len(data)
        if self.escape_whitespaces:
            space = norm == 32
            times = np.where(space, 3, 1)
            ends = np.cumsum(times)
            marks = ends[space] - 3
            norm, source = np.repeat(norm, times), np.repeat(source, times)
            for k in range(3):
                norm[marks + k] = MARK[k]
        out = norm.tobytes()
        if self.dummy_prefix and out:
            prefix = MARK if self.escape_whitespaces else b" "
            out, source = prefix + out, np.concatenate([np.full(len(prefix), source[0]), source])
        return out, np.append(source, end)

    def _mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        out, source, at, end = bytearray(), [], 0, 0
        while at < len(data):
            found = self.charmap.longest_prefix(data, at)
            if found:
                size, text = found
            else:
                size = 1 + sum((x & 0xC0) == 0x80 for x in data[at + 1 : at + 4]) if data[at] >= 0xC0 else 1
                lead = data[at]
                size = min(size, 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
                text = data[at : at + size]
            if self.remove_extra_whitespaces and text.strip(b" ") == b"" and (not out or out[-1] == 32):
                text = b""
            out += text
            source += [at] * len(text)
            at += size
            end = at if text else end
        if self.remove_extra_whitespaces:
            while out and out[-1] == 32:
                out.pop()
                end = source.pop()
        return np.frombuffer(bytes(out), np.uint8), np.asarray(source, np.int64), end


class Codec:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        self.normalizer = Normalizer(CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        # a byte piece (type 6) stands for one normalised byte
        self.sizes = np.array([1 if x.type == 6 else len(x.piece.encode()) for x in model.pieces], np.int64)
        self.pieces = [x.piece.encode() for x in model.pieces]
        self.unknown = model.trainer_spec.unk_id

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []

    def spans(self, data: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece in the original bytes; a piece without source bytes has an empty span."""
        norm, source = self.normalizer(data)
        sizes = self.sizes[np.asarray(ids, np.int64)]
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(norm):
            # unknown characters stand for as many bytes as they have: only models without byte pieces get here
            return self._slow_spans(data, ids, norm, source)
        return source[ends - sizes], source[ends]

    def _slow_spans(self, data: bytes, ids: list[int], norm: bytes, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As spans, where a piece may be unknown: it stands for all that is before the next known piece."""
        at, out = 0, []
        for n, k in enumerate(ids):
            if k == self.unknown:
                known = next((self.pieces[x] for x in ids[n + 1 :] if x != self.unknown), None)
                found = -1 if known is None else norm.find(known, at + 1)
                end = found if found > 0 else len(norm)
            else:
                end = at + int(self.sizes[k])
            out.append((source[min(at, len(norm))], source[min(end, len(norm))]))
            at = end
        return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def sp_encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, ids, starts, ends (byte spans in the text), decoded.

    Null or empty text: no ids, decoded empty. Repeated rows give repeated rows, an empty table an empty result; other
    columns are ignored. model: a path that exists on every executor.
    """
    path = model or default_model()
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                texts = batch.column("text").to_pylist()
                ids = codec(path).encode([utf8(x) for x in texts])
                spans = [codec(path).spans(x, y) for x, y in zip(texts, ids)]
                columns = [batch.column("doc_id"), ids, [x[0] for x in spans], [x[1] for x in spans], codec(path).decode(ids)]
                yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(x, f.type) for x, f in zip(columns[1:], list(kinds)[1:]))], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), raw("text").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")


def sp_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """sp_encode's rows as digests, made in the same task: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of each
    piece's start and end in the text's bytes, as 64-bit little-endian numbers), spans_tile (the spans follow each other from
    the text's first byte to its last), n_empty_spans.

    Null or empty text: no ids and no spans. Repeated rows give repeated rows, an empty table an empty result; other columns
    are ignored. Very long texts: some ten bytes of memory for each of theirs.
    """
    path = model or default_model()
    kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string()), ("spans_tile", pa.bool_()), ("n_empty_spans", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                own, texts, rows = codec(path), batch.column("text").to_pylist(), []
                ids = own.encode([utf8(x) for x in texts])
                for doc_id, data, numbers, decoded in zip(batch.column("doc_id").to_pylist(), texts, ids, own.decode(ids)):
                    starts, ends = own.spans(data, numbers)
                    tile = bool(not len(starts) and not data or len(starts) and starts[0] == 0 and ends[-1] == len(data) and (starts[1:] == ends[:-1]).all())
                    rows.append((doc_id, len(numbers), hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), hashlib.sha256(np.stack([starts, ends], axis=1).astype("<i8").tobytes()).hexdigest(), tile, int((starts == ends).sum())))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), raw("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, spans_tile boolean, n_empty_spans long")
