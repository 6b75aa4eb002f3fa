"""Hashed n-gram features of whole texts, as numpy index arrays; two logistic models use them.

Words are runs of bytes other than ASCII white space. A feature is a hash of one or two neighbouring words,
or of a few neighbouring characters, reduced to a table of 2**bits places. A text's features of a family are
averaged, so that a score does not grow with the text's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from lodestone.llm.shared import mix, row_sums, span_hashes, words_of


@dataclass(frozen=True)
class Family:
    """Feature places in row order and the bounds of each row."""

    places: np.ndarray
    bounds: np.ndarray


def word_families(data: np.ndarray, offsets: np.ndarray, bits: int, hashes: np.ndarray | None = None, first: np.ndarray | None = None) -> list[Family]:
    """Single words and pairs of neighbours. A row's last word pairs with nothing, so a row has one pair less.

    All pairs of a word with itself share one place, so that repetition of words never seen before is seen.
    """
    if hashes is None or first is None:
        starts, ends, first = words_of(data, offsets)
        hashes = span_hashes(data, starts, ends)
    mask = np.uint64((1 << bits) - 1)
    single = (hashes & mask).astype(np.int64)
    with np.errstate(over="ignore"):
        pair = (mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:]) & mask).astype(np.int64) if len(hashes) > 1 else np.zeros(0, np.int64)
    pair[hashes[:-1] == hashes[1:]] = 0
    inner = np.ones(len(pair), bool)
    cuts = first[1:-1]
    inner[cuts[(cuts > 0) & (cuts <= len(pair))] - 1] = False
    kept = np.concatenate([[0], np.cumsum(inner)])
    return [Family(single, first), Family(pair[inner], kept[np.minimum(first, len(pair))])]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each UTF-8 character packed into a number, and the number of each row's first character (with the end)."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if len(starts) == len(data):
        return data.astype(np.uint32), offsets
    code = data[starts].astype(np.uint32)
    sizes = np.diff(starts, append=len(data))
    for j in range(1, 4):
        more = np.flatnonzero(sizes > j)
        code[more] |= data[starts[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return code, np.searchsorted(starts, offsets)


def character_families(data: np.ndarray, offsets: np.ndarray, bits: int, sizes: tuple[int, ...] = (2, 4)) -> Iterator[Family]:
    """Runs of neighbouring characters (code points) of the given sizes. Runs over the border of two rows are left out."""
    chars, first = characters(data, offsets)
    for size in sizes:
        n = max(0, len(chars) - size + 1)
        code = chars[:n].copy()
        with np.errstate(over="ignore"):
            for j in range(1, size):
                code *= np.uint32(0x9E3779B1)
                code += chars[j : j + n]
            code ^= code >> np.uint32(15)
            code *= np.uint32(2246822519)
            code ^= code >> np.uint32(13)
            code *= np.uint32(2654435761)
            code >>= np.uint32(32 - bits)
        ends = np.maximum(first[1:] - size + 1, first[:-1])
        whole = np.ones(n, bool)
        for back in range(1, size):  # a run that begins so near a row's end goes over it
            at = first[1:] - back
            whole[at[(at >= first[:-1]) & (at < n)]] = False
        bounds = np.concatenate([[0], np.cumsum(np.maximum(0, ends - first[:-1]))])
        yield Family(code[whole], bounds)


def margins(families: Iterable[Family], tables: list[np.ndarray], bias: float) -> np.ndarray:
    """Sparse dot products: the mean weight of each family's features, summed over the families, one after the other."""
    total = np.float64(bias)
    for family, table in zip(families, tables, strict=True):
        total = total + row_sums(np.take(table, family.places), family.bounds) / np.maximum(np.diff(family.bounds), 1)
    return total


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def row_features(families: list[Family], row: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, mean counts) of one row, by family."""
    found = []
    for family in families:
        own = family.places[family.bounds[row] : family.bounds[row + 1]]
        places, counts = np.unique(own, return_counts=True)
        found.append((places, (counts / max(1, len(own))).astype(np.float64)))
    return found
