"""Cutting texts into the pieces of a byte-level tokenizer's pattern, a chunk of rows at a time in numpy.

The pattern: contractions, runs of letters, of numbers and of other signs, each with a space before it, and white
space. Bytes get the class of their character, changes of class are the borders, and a few moves of borders do the
rest. Equal pieces of a chunk are found by their bytes, so that each is encoded once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import public_tokenizers

from lodestone.llm.shared import LONG_SPAN, span_keys, window_reader

#: The one pattern that is cut here.
PATTERN = public_tokenizers.PATTERN
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: Code points up to here have classes that do not depend on the version of Unicode.
LAST_POINT = 0x24F


def _class(point: int) -> int:
    if point in (0x20, *range(0x09, 0x0E)):
        return SPACE
    if point in (0, 0x85, 0xA0, *range(0x1C, 0x20)) or point > LAST_POINT:
        return ODD  # NUL ends a key, the others are white space to some libraries only
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(point))[0], OTHER)


#: Classes of bytes (of those that begin two-byte characters only a placeholder), and of two-byte characters by their bytes.
_ONE = np.array([_class(b) if b < 0x80 else ODD for b in range(256)], np.uint8)
_TWO = np.array([_class(p) for p in range(0x80, 0x280)], np.uint8)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each piece (with the end of all), number of the first piece of each row (with the end), and which
    rows hold characters that this way cannot cut; pieces of those are not to be used."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), np.zeros(len(offsets) - 1, bool)
    cls = _ONE[data]
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    if len(two):
        cls[two] = cls[two + 1] = _TWO[(data[two].astype(np.int64) - 0xC2) * 64 + (data[two + 1] & 63)]
    heads = np.unique(offsets[:-1][offsets[:-1] < len(data)])
    last = np.zeros(len(data), bool)
    last[heads[1:] - 1] = last[-1] = True
    starts = np.empty(len(data) + 1, bool)
    starts[1:-1] = cls[1:] != cls[:-1]
    starts[heads] = starts[-1] = True
    space, blank = cls == SPACE, data == 0x20
    joined = np.flatnonzero(starts[1:-1] & ~space[1:] & blank[:-1] & ~last[:-1]) + 1  # a space goes with what follows
    starts[joined] = False
    starts[:-2] |= space[:-1] & ~space[1:] & ~last[:-1]  # white space before a run ends one character earlier
    quotes = np.flatnonzero((data == ord("'")) & starts[:-1] & ~last)
    if len(quotes):
        a = data[quotes + 1]
        room = ~last[quotes + 1]
        b = np.where(room, data[np.minimum(quotes + 2, len(data) - 1)], 0)
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        starts[quotes[short | long] + 1] = False
        starts[quotes[short] + 2] = starts[quotes[long] + 3] = True
    at = np.flatnonzero(starts)
    odd = np.flatnonzero(cls == ODD)
    rows = np.zeros(len(offsets) - 1, bool)
    if len(odd):
        rows[np.searchsorted(offsets, odd, side="right") - 1] = True
    return at, np.searchsorted(at, offsets), rows


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, the same for spans of equal bytes (none of which is NUL), and a span for each number."""
    n, part = ends - starts, window_reader(data, starts, ends)
    short = np.flatnonzero(n <= 8)
    codes = np.empty(len(starts), np.int64)
    codes[short], found = pd.factorize(part(short, 0))
    long = np.flatnonzero(n > 8)
    if len(long):
        own, uniques = pd.factorize(span_keys(data, starts[long], ends[long]))
        first = np.empty(len(uniques), np.int64)
        first[own[::-1]] = long[::-1]
        like = first[own]
        same = n[long] == n[like]
        for j in range(0, LONG_SPAN, 8):
            more = np.flatnonzero(same & (n[long] > j))
            same[more] = part(long[more], j) == part(like[more], j)
        for k in np.flatnonzero(same & (n[long] > LONG_SPAN)):
            same[k] = like[k] == long[k] or bool((data[starts[long[k]] : ends[long[k]]] == data[starts[like[k]] : ends[like[k]]]).all())
        own[~same] = len(uniques) + np.arange((~same).sum())  # spans that share a key with others stand for themselves
        codes[long] = own + len(found)
    spans = np.empty(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    spans[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, spans


def encoded(data: np.ndarray, offsets: np.ndarray, ids_of: Callable[[list[bytes]], list[bytes]], whole: Callable[[str], np.ndarray], special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after the other, and where each row's begin (with the end).

    ids_of: from pieces to their ids, as little-endian unsigned 32-bit integers. whole: from a text to its ids, for texts
    that cannot be cut here, and those that hold the two bytes `special`.
    """
    starts, firsts, odd = cut(data, offsets)
    if special and len(data) > 1:
        met = np.flatnonzero((data[:-1] == special[0]) & (data[1:] == special[1]))
        odd[np.searchsorted(offsets, met, side="right") - 1] = True
    if odd.any():  # their pieces are not looked up
        used = np.repeat(~odd, np.diff(firsts))
        own, ends = starts[:-1][used], starts[1:][used]
        firsts = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(firsts)))])
    else:
        own, ends = starts[:-1], starts[1:]
    codes, spans = distinct(data, own, ends)
    raw = data.tobytes()
    found = ids_of([raw[s:e] for s, e in zip(own[spans].tolist(), ends[spans].tolist(), strict=True)])
    flat = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    begins = (np.cumsum(sizes) - sizes)[codes]
    each = sizes[codes]
    places = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(begins - places[:-1], each) + np.arange(places[-1])]
    bounds = places[firsts]
    if not odd.any():
        return ids, bounds
    parts = [whole(raw[offsets[i] : offsets[i + 1]].decode()) if odd[i] else ids[bounds[i] : bounds[i + 1]] for i in range(len(odd))]
    return np.concatenate(parts).astype(np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
