"""Word shingles of texts as 64-bit numbers, by whole batches of texts.

A word's number comes from prefix sums of byte values times powers of an odd base, modulo 2^64, so no word is made
a string; a shingle's from its words'. Two different shingles get the same number with chance 2^-64 or so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of data (between ASCII white space), their starts and their ends."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turn[::2], turn[1::2]
    n = len(raw)
    power, inverse = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[:-1], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles (int64) of each text, ASCII letters in lower case; a text of fewer words has one, of all of them."""
    at = 0
    while at < len(texts):  # portions of about 1 MB
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) <= 1 << 20):
            held += len(texts[upto]) + 1
            upto += 1
        part = texts[at:upto]
        words, starts, _ = word_numbers(b"\n".join(part).lower())
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        first = np.searchsorted(starts, bounds)
        m = max(0, len(words) - width + 1)
        whole = np.zeros(m, np.uint64)
        for k in range(width):
            whole += words[k : k + m] * _PLACE[k]
        whole = _mix(whole).view(np.int64)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            if hi - lo >= width:
                yield np.unique(whole[lo : hi - width + 1])
            elif hi > lo:
                short = np.uint64(hi - lo)
                with np.errstate(over="ignore"):
                    for k in range(hi - lo):
                        short = short + words[lo + k] * _PLACE[width + k]
                yield _mix(np.array([short], np.uint64)).view(np.int64)
            else:
                yield np.empty(0, np.int64)
        at = upto
