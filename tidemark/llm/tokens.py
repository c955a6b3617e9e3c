"""Token and shingle hashes of whole texts with numpy, the same on every machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes handled at once; a longer text is a chunk of its own.
CHUNK = 1 << 20

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_symbols = _space.copy()
_symbols[[b for b in range(128) if not chr(b).isalnum()]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, CHUNK + 1024), base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def scramble(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; a bijection for each salt."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(texts: list[str | None], letters_only: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """``(position, hashes)`` for each text: one hash per word, A-Z folded to lower case.

    Words are runs of bytes other than blanks, or, with ``letters_only``, other than ASCII blanks and symbols.
    A null text has no words.
    """
    first, size, chunk = 0, 0, []
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass").lower() if t else b""
        if chunk and size + len(raw) > CHUNK:
            yield from _hash_chunk(first, chunk, letters_only)
            first, size, chunk = i, 0, []
        chunk.append(raw)
        size += len(raw) + 1
    if chunk:
        yield from _hash_chunk(first, chunk, letters_only)


def _hash_chunk(first: int, raw: list[bytes], letters_only: bool) -> Iterator[tuple[int, np.ndarray]]:
    a = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    blank = (_symbols if letters_only else _space)[a]
    before = np.concatenate(([True], blank[:-1]))
    starts, ends = np.flatnonzero(before & ~blank), np.flatnonzero(~before & blank)
    up, down = _power(len(a) + 1)
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=prefix[1:])
    h = scramble((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    cuts = np.searchsorted(starts, at)
    for k in range(len(raw)):
        yield first + k, h[cuts[k] : cuts[k + 1]]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; a shorter text is one shingle, an empty one has none."""
    n = len(h)
    if n == 0:
        return h
    width = min(n, k)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0x100000001B3) + h[j : n - width + 1 + j]
    return scramble(acc, k)
