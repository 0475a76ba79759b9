"""Words of whole batches of texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd, so that it has an inverse among 64-bit words.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
#: Bytes of text handled at once, unless one text has more.
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Powers:
    up, down = _powers(BASE, 1), _powers(INVERSE, 1)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            up, down = _powers(BASE, n), _powers(INVERSE, n)
            if n > 4 * CHUNK:  # a very long text; its tables go with it
                return up, down
            cls.up, cls.down = up, down
        return cls.up, cls.down


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with (H[e] - H[s]) * INVERSE**s a hash of data[s:e]."""
    up, _ = Powers.of(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def slice_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = Powers.of(len(h))
    return mix64((h[ends] - h[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) << np.uint64(40))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word; a word is a run of bytes that are no ASCII white space."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    edge = np.r_[True, ~solid[:-1]]
    first = offsets[:-1][offsets[:-1] < len(data)]
    edge[first] = True
    starts = np.flatnonzero(solid & edge)
    edge = np.r_[~solid[1:], True]
    edge[(offsets[1:] - 1)[offsets[1:] > offsets[:-1]]] = True
    ends = np.flatnonzero(solid & edge) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
