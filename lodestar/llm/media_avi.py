"""Media columns: AVI motion-JPEG. Frames are baseline grey JPEGs of 24 by 24 blocks.

A payload byte is a block's mean: its DC coefficient, quantised by 8, is the byte minus 128 exactly, so the format's unit,
a block at 1/8 scale, is stored without loss. The Huffman codes make each block of the writer 16 bits long; the reader
takes any baseline grey JPEG and walks all frames of a batch in step, one block after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import raw, slices

SIDE = 24
UNIT = SIDE * SIDE
FPS = 25
BATCH_BYTES = 2 << 20
#: Frames that are decoded in step; bounds the memory of one very long payload.
MOST_FRAMES = 4096
#: Order of an 8 by 8 block's coefficients in the stream.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))

# ---- writing


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _table(kind: int, lengths: list[int], symbols: list[int]) -> bytes:
    return bytes([kind, *(lengths.count(n) for n in range(1, 17)), *symbols])


#: DC categories 8 to 0 with codes of 4 to 12 bits, so that code and extra bits are 12 long; the end of a block has 4.
DC_SYMBOLS, DC_LENGTHS = list(range(8, -1, -1)), list(range(4, 13))
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, _table(0x00, DC_LENGTHS, DC_SYMBOLS) + _table(0x10, [4], [0]))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _block_codes() -> np.ndarray:
    """The 16 bits of a block for each DC difference from -255 to 255."""
    codes, code, last = {}, 0, DC_LENGTHS[0]
    for size, symbol in zip(DC_LENGTHS, DC_SYMBOLS):
        code <<= size - last
        codes[symbol], last = code, size
        code += 1
    out = []
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        extra = diff if diff > 0 else diff + (1 << s) - 1
        out.append((codes[s] << s | extra) << 4)
    return np.array(out, ">u2")


BLOCK_CODES = _block_codes()


def jpeg_frames(payload: bytes) -> np.ndarray:
    """One JPEG a row; payload is a multiple of UNIT bytes. No code holds a byte of 255, so none needs stuffing."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, UNIT).astype(np.int16) - 128
    diffs = np.diff(blocks, axis=1, prepend=np.zeros((len(blocks), 1), np.int16))
    coded = BLOCK_CODES[diffs + 255].view(np.uint8)
    size = len(HEADER) + 2 * UNIT + 2
    frames = np.zeros((len(blocks), size), np.uint8)
    frames[:, : len(HEADER)] = np.frombuffer(HEADER, np.uint8)
    frames[:, len(HEADER) : -2] = coded.reshape(len(blocks), -1)
    frames[:, -2:] = (0xFF, 0xD9)
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    frames = jpeg_frames(payload)
    n, size = frames.shape
    padded = size + size % 2
    rows = np.zeros((n, 8 + padded), np.uint8)
    rows[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), np.uint8)
    rows[:, 8 : 8 + size] = frames
    index = np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["offset"], index["size"] = b"00dc", 0x10, 4 + np.arange(n) * (8 + padded), size
    px = SIDE * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, size * FPS, 0, 0x10, n, 0, 1, size, px, px, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, size, 0xFFFFFFFF, 0, 0, 0, px, px)
    strf = struct.pack("<IiiHH4sIiiII", 40, px, px, 1, 8, b"MJPG", px * px, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + rows.tobytes()) + _chunk(b"idx1", index.tobytes()))


# ---- reading


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The video frames that the index lists, in order, and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, index, rate = None, None, float(FPS)
    for name, a, b in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"movi":
            movi = a
        elif name == b"idx1":
            index = np.frombuffer(data, [("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")], (b - a) // 16, a)
        elif name == b"LIST" and data[a : a + 4] == b"hdrl":
            for part, c, _ in _chunks(data, a + 4, b):
                if part == b"avih":
                    rate = 1e6 / max(1, struct.unpack_from("<I", data, c)[0])
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    video = index[np.char.endswith(index["id"], b"dc")]
    # offsets count from the list's name, in some files from the file's start
    base = movi if not len(video) or data[movi + int(video["offset"][0]) :][:4] == video["id"][0] else 0
    starts = base + video["offset"].astype(np.int64) + 8
    return [data[a : a + n] for a, n in zip(starts.tolist(), video["size"].tolist())], rate


class FrameHeader:
    """What stands before a frame's coded blocks: size, quantisation of the DC, and the two Huffman tables."""

    def __init__(self, data: bytes) -> None:
        at, tables, quant, which = 2, {}, {}, None
        while True:
            mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif mark == 0xC0:
                _, height, width, parts = struct.unpack_from(">BHHB", body)
                if parts != 1:
                    raise ValueError("only grey frames")
                self.rows, self.columns, which = -(-height // 8), -(-width // 8), body[8]
            elif mark == 0xC4:
                while body:
                    counts = body[1:17]
                    n = sum(counts)
                    tables[body[0]] = self.lookup(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            at += 2 + size
            if mark == 0xDA:
                self.dc, self.ac, self.quant = tables[body[2] >> 4], tables[0x10 | body[2] & 15], quant[which]
                self.size = at
                self.bytes = data[:at]
                return

    @staticmethod
    def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
        """For each 16 bits: length of the code that they begin with, times 256, plus its symbol."""
        table, at, code = np.zeros(1 << 16, np.int64), 0, 0
        for size, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                first = code << (16 - size)
                table[first : first + (1 << (16 - size))] = size << 8 | symbol
                code += 1
            at += n
            code <<= 1
        return table


def decode_frames(frames: list[bytes], coefficients: bool = False) -> list[np.ndarray]:
    """Each frame's blocks at 1/8 scale (rows by columns, uint8), or all quantised coefficients (rows, columns, 64)."""
    headers: list[FrameHeader] = []
    of: list[int] = []
    for frame in frames:
        for k in range(len(headers) - 1, -1, -1):
            if frame.startswith(headers[k].bytes):
                break
        else:
            headers.append(FrameHeader(frame))
            k = len(headers) - 1
        of.append(k)
    out: list[np.ndarray] = [np.zeros(0)] * len(frames)
    kinds = np.array(of)
    for k, header in enumerate(headers):
        own = np.flatnonzero(kinds == k).tolist()
        for part in (own[a : a + MOST_FRAMES] for a in range(0, len(own), MOST_FRAMES)):
            for x, y in zip(part, _decode([frames[j][header.size :] for j in part], header, coefficients)):
                out[x] = y
    return out


def _decode(coded: list[bytes], header: FrameHeader, coefficients: bool) -> np.ndarray:
    coded = [x.replace(b"\xff\x00", b"\xff") for x in coded]
    longest = max(map(len, coded)) + 16
    data = np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in coded), np.uint8)
    # the 64 bits from each byte on: of these 57 at least follow any bit position
    window = np.zeros(len(data), np.uint64)
    for k in range(8):
        window[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    n, blocks = len(coded), header.rows * header.columns
    base = np.arange(n, dtype=np.int64) * longest
    at, dc = np.zeros(n, np.int64), np.zeros(n, np.int64)
    means = np.zeros((blocks, n), np.int64)
    coefs = np.zeros((n, blocks, 64), np.int32) if coefficients else None
    one, far = np.uint64(1), np.uint64(63)

    def signed(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
        """s bits at the top of bits, as the number they stand for in category s."""
        value = ((bits >> one) >> (far - s.astype(np.uint64))).astype(np.int64)
        return value - np.where(value < (1 << s >> 1), (1 << s) - 1, 0)

    for block in range(blocks):
        bits = window[base + (at >> 3)] << (at & 7).astype(np.uint64)
        found = header.dc[(bits >> np.uint64(48)).astype(np.int64)]
        size, s = found >> 8, found & 255
        bits <<= size.astype(np.uint64)
        dc += signed(bits, s)
        at += size + s
        means[block] = dc
        if coefs is not None:
            coefs[:, block, 0] = dc
        bits <<= s.astype(np.uint64)
        found = header.ac[(bits >> np.uint64(48)).astype(np.int64)]
        at += found >> 8
        live = np.flatnonzero(found & 255)
        found = found[live]
        k = np.ones(len(live), np.int64)
        while len(live):
            run, s = (found & 255) >> 4, found & 15
            k += np.where((run == 15) & (s == 0), 15, run)
            bits = window[base[live] + (at[live] >> 3)] << (at[live] & 7).astype(np.uint64)
            value = signed(bits, s)
            if coefs is not None:
                coefs[live, block, np.minimum(k, 63)] = value
            at[live] += s
            k += 1
            more = k < 64
            live, k = live[more], k[more]
            bits = window[base[live] + (at[live] >> 3)] << (at[live] & 7).astype(np.uint64)
            found = header.ac[(bits >> np.uint64(48)).astype(np.int64)]
            at[live] += found >> 8
            more = (found & 255) > 0
            live, k, found = live[more], k[more], found[more]
    if coefs is not None:
        return coefs.reshape(n, header.rows, header.columns, 64)
    grey = np.clip((means * header.quant[0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return np.ascontiguousarray(grey.T).reshape(n, header.rows, header.columns)


def full_frame(frame: bytes) -> np.ndarray:
    """All pixels of a frame."""
    coefs = decode_frames([frame], coefficients=True)[0].astype(float)
    header = FrameHeader(frame)
    table = np.zeros((*coefs.shape[:2], 64))
    table[..., ZIGZAG] = coefs * header.quant
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[None]
    pixels = np.einsum("xu,rcuv,yv->rxcy", basis, table.reshape(*coefs.shape[:2], 8, 8), basis)
    return np.clip(np.rint(pixels.reshape(coefs.shape[0] * 8, -1)) + 128, 0, 255).astype(np.uint8)


# ---- shots

BINS, SPREAD, NEAR, LEAST = 16, 1.5, 8, 0.12
#: A difference from which a cut is one whatever is around it, and the other differences that a mean and spread need.
HARD, FEW = 0.5, 3


def histograms(blocks: np.ndarray) -> np.ndarray:
    """Grey histograms of frames (frames, units)."""
    n = len(blocks)
    return np.bincount((np.arange(n)[:, None] * BINS + (blocks >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)


def shot_bounds(hists: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot. A cut is where a histogram difference exceeds the mean of the others around it
    by SPREAD standard deviations, and LEAST; or is HARD, as among few others or many cuts."""
    n = len(hists)
    if n < 2:
        return [(0, n - 1)] if n else []
    diffs = np.abs(np.diff(hists, axis=0)).sum(axis=1) / (2 * hists[:-1].sum(axis=1))
    sums = np.concatenate([[0.0], np.cumsum(diffs)])
    squares = np.concatenate([[0.0], np.cumsum(diffs * diffs)])
    k = np.arange(len(diffs))
    a, b = np.maximum(0, k - NEAR), np.minimum(len(diffs), k + NEAR + 1)
    others = b - a - 1
    mean = (sums[b] - sums[a] - diffs) / np.maximum(1, others)
    spread = np.sqrt(np.maximum(0, (squares[b] - squares[a] - diffs * diffs) / np.maximum(1, others) - mean * mean))
    stands_out = (others >= FEW) & (diffs > mean + SPREAD * spread) & (diffs > LEAST)
    cuts = (np.flatnonzero(stands_out | (diffs >= HARD)) + 1).tolist()
    return list(zip([0, *cuts], [x - 1 for x in cuts] + [n - 1]))


# ---- Spark


def padded(data: bytes, fill: int = 255) -> bytes:
    """data and fill bytes up to a positive multiple of UNIT."""
    return data + bytes([fill]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as a media column: doc_id, n_bytes, media (AVI). Null text: like an empty one."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                texts = batch.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([write_avi(padded(x)) for x in texts], pa.binary())], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw("text").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: What reading a damaged file may raise.
DAMAGED = (ValueError, IndexError, KeyError, AttributeError, struct.error)


def _read(media: bytes | None) -> tuple[list[bytes], float] | None:
    try:
        return read_avi(media) if media is not None else None
    except DAMAGED:
        return None


def _blocks(frames: list[bytes]) -> list[np.ndarray] | None:
    try:
        return decode_frames(frames)
    except DAMAGED:
        return None


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[np.ndarray] | None, float]]:
    """Each media value's frames at 1/8 scale, or none where it is null or damaged; a batch's frames are decoded together."""
    rows = batch.to_pylist()
    read = [_read(x["media"]) for x in rows]
    together = _blocks([f for found in read if found for f in found[0]])
    at = 0
    for row, found in zip(rows, read):
        if not found:
            yield row, None, 0.0
        elif together is None:
            # one of the batch is damaged: each is tried by itself
            yield row, _blocks(found[0]), found[1]
        else:
            yield row, together[at : at + len(found[0])], found[1]
            at += len(found[0])


def frame_histograms(blocks: list[np.ndarray]) -> np.ndarray:
    """Histograms of frames of any sizes."""
    if len({x.size for x in blocks}) == 1:
        return histograms(np.stack([x.ravel() for x in blocks]))
    return np.concatenate([np.zeros((0, BINS), np.int64), *(histograms(x.reshape(1, -1)) for x in blocks)])


def media_clips(media: DataFrame) -> DataFrame:
    """A row for each shot of media (doc_id, media): doc_id, clip, first_frame, last_frame, start_ms, end_ms.

    Null or damaged media, and media without frames: no row. Repeated rows give repeated rows; other columns are ignored.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", 3 * BATCH_BYTES):
                rows = []
                for row, blocks, rate in _decoded(batch):
                    for k, (a, b) in enumerate(shot_bounds(frame_histograms(blocks or []))):
                        rows.append((row["doc_id"], k, a, b, round(a * 1000 / rate), round((b + 1) * 1000 / rate)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    return media.where("media is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, clip int, first_frame int, last_frame int, start_ms long, end_ms long")


def media_digests(media: DataFrame) -> DataFrame:
    """What is read back from media (doc_id, n_bytes, media), a row each: payload and file digests, and the clips as a feature.

    Null or damaged media: null payload columns and the feature "unreadable"; of null media all media columns are null too.
    Equal media, equal values. An empty table gives an empty result; other columns are ignored. A value is decoded whole, its
    frames MOST_FRAMES at a time; a column's value ends at 2 GB.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", 3 * BATCH_BYTES):
                rows = []
                for row, blocks, rate in _decoded(batch):
                    own = row["media"]
                    file = (None, None) if own is None else (len(own), hashlib.sha256(own).hexdigest())
                    if blocks is None:
                        rows.append((row["doc_id"], row["n_bytes"], None, None, None, *file, "unreadable"))
                        continue
                    payload, hists = b"".join(x.tobytes() for x in blocks), frame_histograms(blocks)
                    clips = shot_bounds(hists)
                    feature = f"frames={len(blocks)};clips={len(clips)};ms={','.join(f'{round(a * 1000 / rate)}-{round((b + 1) * 1000 / rate)}' for a, b in clips)};hist={'.'.join(map(str, hists.sum(axis=0)))}"
                    rows.append((row["doc_id"], row["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *file, feature))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
