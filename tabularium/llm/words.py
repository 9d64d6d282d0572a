"""Words and rolling hashes of texts, worked out on whole arrays of bytes inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes or tokens handled at once.
BLOCK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)

# The multipliers of a 64-bit finaliser.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

# What stands between words made of anything but white space.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
# What stands between words of letters and digits; all beyond ASCII counts as letters.
NOT_ALPHANUMERIC = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
# A-Z to a-z and all that is no word to a space.
_PLAIN = bytes(0x20 if c in NOT_ALPHANUMERIC else c + 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[start:stop]`` for each pair; equal ranges have equal hashes."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[stops] - sums[starts]) * down[starts]


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` values."""
    n = len(values)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[: n - size + 1]


def plain(data: bytes) -> bytes:
    """Words of letters and digits, A-Z lower-cased, with any number of spaces between."""
    return data.translate(_PLAIN)


def word_hashes(data: bytes, between: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, and its start in bytes. ``between`` lists the bytes that are in no word."""
    is_between = np.zeros(256, bool)
    is_between[list(between)] = True
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    whole = np.frombuffer(data, np.uint8)
    while at < len(data):
        # Blocks end where a word does; a word longer than a block stays whole.
        end, step = at + 2 * BLOCK, 2 * BLOCK
        while end < len(data) and not is_between[whole[at:end]].any():
            end += step
        if end < len(data):
            end = at + int(np.flatnonzero(is_between[whole[at:end]])[-1]) + 1
        block = whole[at:end]
        inside = np.concatenate(([False], ~is_between[block], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[0::2], edges[1::2]
        raw = range_hashes(block.astype(np.uint64) + np.uint64(1), first, last)
        hashes.append(mixed(raw ^ (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain words of several texts, and the bounds of each text among them."""
    joined = b" ".join(texts)
    hashes, starts = word_hashes(plain(joined))
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends)))


def texts_of(batches: Iterator[pa.RecordBatch], key: str = "key", text: str = "text") -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts, about a block of bytes at a time; null texts are empty."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for one, value in zip(batch.column(key).to_pylist(), batch.column(text), strict=True):
            buffer = value.as_buffer()
            keys.append(one)
            texts.append(buffer.to_pybytes() if buffer is not None else b"")
            size += len(texts[-1])
            if size >= BLOCK:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts
