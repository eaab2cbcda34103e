"""Word shingles of whole texts as 64-bit hashes, for the operators that run in Python tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

WIDTH = 5
#: Odd multipliers that tell the places of a window apart.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_BYTES of text each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= SLICE_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; bytes.split knows just the six separators."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(texts: list[str | None], lists: list[list[bytes]] | None = None) -> list[np.ndarray]:
    """For each text, the hashes of its words in order; lists has the words if they are split already."""
    lists = [split_words(t) for t in texts] if lists is None else lists
    flat = np.empty(sum(map(len, lists)), dtype=object)
    at, bounds = 0, [0]
    for ws in lists:
        flat[at : at + len(ws)] = ws
        at += len(ws)
        bounds.append(at)
    hashed = pd.util.hash_array(flat, categorize=False) if at else np.empty(0, dtype=np.uint64)
    return [hashed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word windows, or of the whole if it is shorter."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    if n < WIDTH:
        s = np.sum(hashes * PLACES[:n], dtype=np.uint64) + np.uint64(n)
        return mix(np.array([s], dtype=np.uint64))
    s = hashes[: n - WIDTH + 1] * PLACES[0]
    for k in range(1, WIDTH):
        s = s + hashes[k : n - WIDTH + 1 + k] * PLACES[k]
    return np.unique(mix(s))


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
