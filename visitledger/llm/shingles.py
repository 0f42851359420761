"""Sets of word shingles as hash arrays."""

from __future__ import annotations

import numpy as np

from visitledger.llm.runs import mix, powers, sealed, words_of

#: Words of a shingle.
WORDS = 5


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: number of the text and hash, sorted by both.

    Words are runs of letters and digits in lower case. A text of fewer than
    `words` words has one shingle, all of them; without words it has none.
    """
    text, hashes, _, _ = words_of([t.lower() for t in texts])
    if not len(text):
        return text, hashes
    weights = powers(words)
    n = max(0, len(text) - words + 1)
    total = np.zeros(n, np.uint64)
    for j in range(words):
        total += hashes[j : j + n] * weights[j]
    whole = text[:n] == text[words - 1 :]
    owner, found = text[:n][whole], sealed(total[whole], np.uint64(words))
    many = np.bincount(text, minlength=len(texts))
    short = np.flatnonzero((many > 0) & (many < words))
    if len(short):
        first = np.searchsorted(text, short)
        total = np.zeros(len(short), np.uint64)
        for j in range(words - 1):
            inside = many[short] > j
            total[inside] += hashes[first[inside] + j] * weights[j]
        owner = np.concatenate([owner, short])
        found = np.concatenate([found, sealed(total, many[short].astype(np.uint64))])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[fresh], found[fresh]


def set_keys(owner: np.ndarray, found: np.ndarray, many: int) -> tuple[list[bytes | None], np.ndarray]:
    """A 16-byte key of each set, None if it is empty, and its size."""
    sizes = np.bincount(owner, minlength=many)
    full = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes[full])])[:-1].astype(np.int64)
    keys: list[bytes | None] = [None] * many
    if len(full):
        parts = [
            np.add.reduceat(mix(found ^ np.uint64(salt)), starts) + sizes[full].astype(np.uint64)
            for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)
        ]
        data = np.stack(parts, axis=1).astype(">u8").tobytes()
        for i, doc in enumerate(full.tolist()):
            keys[doc] = data[16 * i : 16 * i + 16]
    return keys, sizes


def min_hashes(found: np.ndarray, starts: np.ndarray, many: int) -> np.ndarray:
    """`many` MinHash values, uint32, of each set; one row per start."""
    values = np.empty((len(starts), many), np.uint32)
    for k in range(many):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1)  # odd: the shingles' own hashes are permuted
        values[:, k] = np.minimum.reduceat(mix(found * factor) >> np.uint64(32), starts)
    return values
