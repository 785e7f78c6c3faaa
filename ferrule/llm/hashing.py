"""Vectorised hashes of words and of runs of words, for use inside tasks.

Words are runs of bytes other than space and bytes 9 to 13, ASCII letters lower-cased. A word's hash is the polynomial
of its bytes modulo 2 ** 64, taken from prefix sums over the whole text, then mixed; runs of words combine the hashes
of their words by place. Texts are hashed whole, in pieces that end at a space.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint64) + U64(1)
_LOWER[65:91] += U64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of the places in a run of words.
_PLACES = np.cumprod(np.full(64, 0xD1342543DE82EF95, dtype=np.uint64), dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n + 1:
        size = max(1 << 13, 1 << n.bit_length())
        _tables["up"], _tables["down"] = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _pieces(data: np.ndarray):
    at = 0
    while len(data) - at > 2 * PIECE:
        spaces = np.flatnonzero(_SPACE[data[at + PIECE : at + 2 * PIECE]])
        if not len(spaces):  # one word of more than a piece: take the rest at once
            break
        yield at, data[at : at + PIECE + int(spaces[0])]
        at += PIECE + int(spaces[0])
    yield at, data[at:]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    hashes, starts, ends = [], [], []
    for at, piece in _pieces(raw):
        if not len(piece):
            continue
        up, down = power_tables(len(piece))
        space = np.empty(len(piece) + 2, dtype=np.int8)
        space[0] = space[-1] = 1
        space[1:-1] = _SPACE[piece]
        turn = np.diff(space)
        start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        sums = np.empty(len(piece) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_LOWER[piece] * up[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        starts.append(start + at)
        ends.append(end + at)
    if not hashes:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = words[:n] * _PLACES[0]
    for k in range(1, length):
        total = total + words[k : k + n] * _PLACES[k % 64]
    return mix(total + U64(length))


def shingle_set(text: str | None, length: int) -> np.ndarray:
    """Distinct hashes of the runs of ``length`` words, sorted; a shorter text is one run; without words none."""
    words = word_hashes((text or "").encode())[0]
    if not len(words):
        return words
    return np.unique(run_hashes(words, min(length, len(words))))
