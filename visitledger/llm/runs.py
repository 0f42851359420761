"""Texts of an Arrow batch as one array of code points, and their runs and hashes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Character classes.
OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, from the Unicode database."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    found = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    found[[*range(0x09, 0x0E), 0x85]] = SPACE
    return found


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of `texts` in a row, and the offset of each text (one more at the end)."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer(joined, np.uint32), np.concatenate([[0], ends])


def powers(n: int) -> np.ndarray:
    """1, m, m^2, ... modulo 2^64."""
    found = np.full(n, _MULTIPLIER, np.uint64)  # uint64 arrays wrap around silently
    if n:
        found[0] = 1
    return np.multiply.accumulate(found)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash."""
    h = (h ^ (h >> np.uint64(30))) * _SPREAD
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sealed(sums: np.ndarray, lengths: np.ndarray | np.uint64) -> np.ndarray:
    """The hash of strings whose code points, weighed with `powers`, add up to `sums`."""
    return mix(sums + np.multiply(lengths, _SPREAD, dtype=np.uint64))


def run_hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run, given all runs of `points` in order without gaps."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(points), dtype=np.int64) - np.repeat(starts, lengths)
    values = (points.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return sealed(np.add.reduceat(values, starts), lengths.astype(np.uint64))


def words_of(texts: list[str], keep: tuple[int, ...] = (LETTER, NUMBER)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of `texts`: number of the text, hash, and code point range of each.

    A word is a maximal run of characters of the classes in `keep`, in one text.
    The ranges are places in the texts written one after the other.
    """
    points, offsets = code_points(texts)
    if not len(points):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    inside = np.isin(classes()[points], keep)
    first = np.ones(len(points), bool)
    first[1:] = inside[1:] != inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(points)]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(points)))
    hashes = run_hashes(points, starts, lengths)
    word = inside[starts]
    starts, lengths, hashes = starts[word], lengths[word], hashes[word]
    text = np.searchsorted(offsets, starts, side="right") - 1
    return text, hashes, starts, starts + lengths


def chunks(sizes: list[int], most: int) -> list[slice]:
    """Slices of consecutive items of at most `most` together; larger items stand alone."""
    found, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            found.append(slice(start, i))
            start, total = i, 0
        total += size
    if len(sizes) > start:
        found.append(slice(start, len(sizes)))
    return found
