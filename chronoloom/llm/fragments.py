"""Content-defined fragments of byte strings, so that equal strings meet in equal groups.

Of every ``width``-byte string, the anchor is its k-gram with the least hash, the
leftmost of equal ones. That depends on the string alone, so equal strings,
wherever they stand, have equal anchors at equal offsets. Strings that start at
neighbouring positions and share their anchor form one fragment. All equal strings
of a corpus thus lie in fragments of one anchor hash; a hash that occurs once in
the corpus rules its fragment out.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a k-gram, a power of two.
GRAM = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Positions in a slice take the low bits of a sort key.
POSITION_BITS = 21


def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.arange(1, 257, dtype=np.uint64) * _ODD
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


BYTE_VALUES = _byte_values()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling: a string's hash is made of its halves'."""
    with np.errstate(over="ignore"):
        h = BYTE_VALUES[data]
        base, n = _ODD, 1
        while n < GRAM:
            h = h[:-n] * base + h[n:]
            base = base * base
            n *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from minima within blocks from both of their ends."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def fragments(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of joined strings that end at ``bounds``: anchor hash, first start, number of starts, where the anchor is.

    ``data`` has fewer than 2**POSITION_BITS bytes. Strings shorter than ``width`` have none.
    """
    none = np.zeros(0, np.uint64), *np.zeros((3, 0), np.int64)
    if len(data) < width:
        return none
    h = gram_hashes(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    starts = np.arange(len(anchor))
    whole = np.append(bounds, len(data))[np.searchsorted(bounds, starts, side="right")] >= starts + width
    first = np.flatnonzero(whole & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[:-1]]))
    if not len(first):
        return none
    size = np.add.reduceat(whole, first)  # starts that are not whole lie only at the ends of runs
    return h[anchor[first]], first, size, anchor[first]
