"""Cuts of long texts that depend on their content, so that an edit moves few of them.

A rolling hash stands for the last WINDOW bytes at each place. A text above the bound is cut where the hash is least among the
ends of its words, away from its own ends, and so are its parts: places far from an edit keep their hashes, and their cuts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a hash looks back on, a power of two; no cut lies within this share of a part's ends.
WINDOW, MARGIN = 32, 8


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of it and the WINDOW - 1 before it."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < WINDOW:
        back = np.zeros_like(h)
        back[width:] = h[:-width]
        h = (h ^ (back * np.uint64(0xD6E8FEB86659FD93) + np.uint64(width))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def cut_places(data: bytes, most: int) -> list[int]:
    """Where to cut, in order. Behind white space where a part has any away from its ends, else between characters."""
    if len(data) <= most:
        return []
    own = np.frombuffer(data, np.uint8)
    h = rolling(own)
    white = np.flatnonzero((own == 32) | ((own >= 9) & (own <= 13))) + 1
    # a place before a continuation byte would cut a character
    any_place = np.flatnonzero((own & 0xC0) != 0x80)
    cuts, parts = [], [(0, len(data))]
    while parts:
        a, b = parts.pop()
        if b - a <= most:
            continue
        margin = max(1, (b - a) // MARGIN)
        for places in (white, any_place):
            inner = places[np.searchsorted(places, a + margin) : np.searchsorted(places, b - margin, "right")]
            if len(inner):
                break
        else:
            continue
        at = int(inner[np.argmin(h[inner - 1])])
        cuts.append(at)
        parts += [(a, at), (at, b)]
    return sorted(cuts)


def _parts(texts: pd.Series, most: int) -> pd.Series:
    def one(text: str | None) -> list[dict]:
        data = (text or "").encode()
        ends = [0, *cut_places(data, most), len(data)]
        seen: dict[str, int] = {}
        out = []
        for a, b in zip(ends, ends[1:]):
            part = data[a:b].decode()
            seen[part] = seen.get(part, -1) + 1
            out.append({"text": part, "before": seen[part]})
        return out

    return texts.map(one)


def cut_texts(text: Column, most: int) -> Column:
    """A text's parts of `most` bytes at most (never within a character), in order: text, and how many equal ones come before."""
    if most < 8:
        raise ValueError("a part holds 8 bytes at least")
    return F.pandas_udf(lambda x: _parts(x, most), "array<struct<text:string,before:int>>")(text)
