"""Hashed character n-grams of words, as numpy arrays over a chunk of texts."""

from __future__ import annotations

import numpy as np

from .common import ALNUM, LOWER, mix, word_bounds
from .windows import joined_words

_MASKS = {n: np.uint64((1 << (8 * n)) - 1) for n in range(1, 8)}
_C = np.uint64(0x9E3779B97F4A7C15)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte Latin-1 capitals in lower case."""
    out = LOWER[data]
    if len(out):
        capital = np.zeros(len(out), bool)
        capital[1:] = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[capital] += 0x20
    return out


def word_buffer(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of " word word ... " over all rows, where each word's leading space stands, each row's first word."""
    low = lowered(data)
    bounds = word_bounds(low, offsets, ALNUM)
    words, place = joined_words(low, offsets, bounds=bounds)
    return np.concatenate([[np.uint8(0x20)], words, np.zeros(8, np.uint8)]), place, bounds[2]


def ngrams(buffer: np.ndarray, place: np.ndarray, sizes: tuple[int, ...], bits: int):
    """For each n: buckets of the n-grams starting at each byte of the words' segments, and which of them stay in their word.

    A word's segment is its leading space, its bytes and the next space, so n-grams tell beginnings and ends.
    """
    total = int(place[-1])
    if not total:
        return
    eight = np.ndarray((total,), "<u8", buffer=buffer, strides=(1,))
    room = np.repeat(place[1:], np.diff(place)) - np.arange(total)
    for n in sizes:
        yield n, mix((eight & _MASKS[n]) * _C + np.uint64(n)) >> np.uint64(64 - bits), room >= n - 1


def counts_of(place: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Number of n-grams of each word."""
    length = np.diff(place) + 1
    return sum(np.maximum(0, length - n + 1) for n in sizes)


def word_sums(buffer: np.ndarray, place: np.ndarray, weights: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Sum of ``weights`` over each word's n-grams; one column of weights in, one value per word out."""
    if len(place) < 2:
        return np.zeros(0, np.float64)
    total = np.zeros(int(place[-1]), np.float32)
    for _, bucket, valid in ngrams(buffer, place, sizes, bits):
        total += np.where(valid, weights[bucket], np.float32(0))
    return np.add.reduceat(total, place[:-1], dtype=np.float64)
