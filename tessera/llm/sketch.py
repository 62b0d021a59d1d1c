"""Threshold-scaled document sketches.

A sketch is the set of all shingle hashes below a fixed fraction of the hash range. It grows with the document, so
sketches of very unequal documents estimate containment, and the sketch of a union is the union of sketches.

A short document may have no hash below the limit. Its sketch is its whole set then, told by its hashes, none of which
is below the limit: two such sketches are compared exactly. Beside hashes below the limit the others count for nothing,
so a union may hold some; a sketch of either kind has no likeness to one of the other.

Shingles are of five words, lower-cased A-Z; a text of fewer words has one shingle, all of it. The hashing is done
on whole Arrow batches at once, by running sums over the batch's bytes, and holds one bounded slice of it at a time.

Defined results: a null or empty text, or one without words, has an empty sketch; the likeness of two empty sketches
is 1, of an empty and another one 0; no other text has an empty sketch; rows that repeat have equal sketches.
"""

from __future__ import annotations

import base64

import numpy as np

WORDS = 5
#: One in so many hashes is kept.
SCALE = 4
#: Hashes have 48 bits: eight characters each in base 64.
BITS = 48
_B = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: A random-looking number for each byte.
_BYTE = np.array([(int(b) * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % 2**64 for b in _FOLD], dtype=np.uint64)
_SLICE = 1 << 22


def finish(h: np.ndarray) -> np.ndarray:
    """Spread every bit of h over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _B, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of UTF-8 bytes, in order; A-Z count as a-z. It depends on the word's bytes alone."""
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, dtype=np.uint64)
    within = np.arange(len(raw)) - np.repeat(np.append(0, begin)[: len(begin) + 1], np.diff(np.concatenate([[0], begin, [len(raw)]])))
    longest = int((end - begin).max())
    values = _BYTE[raw]
    if longest <= 1 << 16:
        powers = _powers(longest + 1)
        values = values * powers[np.minimum(within, longest)]
    else:
        values = values * _powers(int(within.max()) + 1)[within]
    values[~inside] = 0
    return finish(np.add.reduceat(values, begin) + (end - begin).astype(np.uint64))


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """A hash of each run of ``n`` words; fewer words are one run."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = h * _B + words[i : len(words) - n + 1 + i]
    return finish(h + np.uint64(n))


def text_shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending."""
    return np.unique(shingle_hashes(word_hashes(np.frombuffer(text.encode(), dtype=np.uint8)), n))


def sketch(text: str, scale: int = SCALE, n: int = WORDS) -> np.ndarray:
    h = shingle_hashes(word_hashes(np.frombuffer(text.encode(), dtype=np.uint8)), n) >> np.uint64(64 - BITS)
    kept = h[h < np.uint64(2**BITS // scale)]
    return np.unique(kept if len(kept) else h)


def below(kept: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """What counts of a sketch: its hashes below the limit, or if there are none, all of it."""
    n = int(np.searchsorted(kept, np.uint64(2**BITS // scale)))
    return kept[:n] if n else kept


def written(kept: np.ndarray) -> str:
    """A sketch as text: the base 64 of six big-endian bytes for each hash, ascending."""
    return base64.b64encode(kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def read(text: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (2, 0))).copy().view(">u8").reshape(-1).astype(np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of the smaller document's shingles that the other one has."""
    a, b = below(a, scale), below(b, scale)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return common(a, b) / min(len(a), len(b))


def merged(sketches: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(sketches)) if sketches else np.empty(0, dtype=np.uint64)
