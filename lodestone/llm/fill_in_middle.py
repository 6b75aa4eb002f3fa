"""Fill-in-the-middle: texts cut in three and put in another order, by one numpy kernel over Arrow's UTF-8 buffers.

A chunk of rows is one byte array. A lookup gives each byte's class, a mask over neighbouring bytes says where a unit
ends, and the running sum of that mask, less its value where a row begins, numbers the units of each row. Looking
the wanted numbers up in the sum gives the cuts of all rows together; one gather lays out all outputs. The way back
finds the three marks and gathers again. No row depends on another, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import IS_SPACE, carried, text_chunks

#: The marks before prefix, suffix and middle; a text that holds one stays as it is.
MARKS = np.frombuffer(b"<P><S><M>", np.uint8)
FORMS = np.array(["plain", "psm", "spm"])
#: Bytes that one gather lays out.
GATHER_BYTES = 1 << 22


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of `source` one after the other, laid out in blocks so that index arrays stay small."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, np.uint8)
    shift = starts - (ends - lengths)
    for low in range(0, total, GATHER_BYTES):
        high = min(total, low + GATHER_BYTES)
        first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high - 1, side="right") + 1
        n = np.minimum(ends[first:last], high) - np.maximum(ends[first:last] - lengths[first:last], low)
        out[low:high] = source[np.repeat(shift[first:last], n) + np.arange(low, high)]
    return out


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The running count of unit ends before each byte (and after the last), and the number of units of each row."""
    count = np.zeros(len(data) + 1, np.int64)
    if len(data):
        inside = ~IS_SPACE[data]
        ends = np.empty(len(data), bool)
        ends[:-1] = inside[:-1] & ~inside[1:]
        ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True  # a row's last byte ends a unit
        np.cumsum(ends, out=count[1:])
    return count, np.diff(count[offsets])


def marks_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks begin, and the number of the first one of each row (with the end)."""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[np.isin(data[at + 1], MARKS[1::3]) & (data[at + 2] == ord(">"))]
    at = at[at + 2 < offsets[np.searchsorted(offsets, at, side="right")]]  # both ends in the same row
    return at, np.searchsorted(at, offsets)


def rearranged(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, fim_percent: int, spm_percent: int) -> tuple[np.ndarray, ...]:
    """Units, form (place in FORMS), code points of prefix and middle, output bytes and output offsets of each row.

    h: four unsigned draws for each row, which choose the two cuts, whether the text is cut at all, and the order.
    """
    count, n = units(data, offsets)
    _, firsts = marks_in(data, offsets)
    base, starts, stops = count[offsets[:-1]], offsets[:-1], offsets[1:]
    two = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    a, b = np.searchsorted(count, base + two[:, 0]), np.searchsorted(count, base + two[:, 1])
    plain = (starts == stops) | (np.diff(firsts) > 0) | (h[:, 2] % 100 >= fim_percent)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm_percent, 2, 1))
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    prefix, middle, suffix = (starts, a - starts), (a, b - a), (b, stops - b)
    mark = [(np.full(len(n), len(data) + 3 * k), np.full(len(n), 3)) for k in range(3)]
    spans = {1: [mark[0], prefix, mark[1], suffix, mark[2], middle], 2: [mark[1], suffix, mark[0], prefix, mark[2], middle]}
    at, size = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    at[:, 0], size[:, 0] = starts, stops - starts
    for code, parts in spans.items():
        own = form == code
        for k, (s, m) in enumerate(parts):
            at[own, k], size[own, k] = s[own], m[own]
    out = gathered(np.concatenate([data, MARKS]), at.ravel(), size.ravel())
    return n, form, points[a] - points[starts], points[b] - points[a], out, np.concatenate([[0], np.cumsum(size.sum(axis=1))])


def restored(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text bytes and offsets of outputs of the given forms, and which of them have the marks of their form."""
    at, firsts = marks_in(data, offsets)
    starts, stops = offsets[:-1], offsets[1:]
    cut = form > 0
    kind = np.append(data[np.minimum(at + 1, max(len(data) - 1, 0))], np.zeros(3, np.uint8)) if len(data) else np.zeros(3, np.uint8)
    place = np.append(at, np.zeros(3, np.int64))
    k = firsts[:-1]
    first, second = np.where(form == 1, ord("P"), ord("S")), np.where(form == 1, ord("S"), ord("P"))
    sound = (np.diff(firsts) == 3) & (place[k] == starts) & (kind[k] == first) & (kind[k + 1] == second) & (kind[k + 2] == ord("M"))
    good = ~cut | sound
    cut &= good
    one, two, three = (starts + 3, place[k + 1]), (place[k + 1] + 3, place[k + 2]), (place[k + 2] + 3, stops)
    at, size = np.zeros((len(form), 3), np.int64), np.zeros((len(form), 3), np.int64)
    at[:, 0], size[:, 0] = starts, np.where(good, stops - starts, 0)
    for code, parts in ((1, [one, three, two]), (2, [two, three, one])):
        own = cut & (form == code)
        for j, (s, e) in enumerate(parts):
            at[own, j], size[own, j] = s[own], (e - s)[own]
    return gathered(data, at.ravel(), size.ravel()), np.concatenate([[0], np.cumsum(size.sum(axis=1))]), good


def _strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data), bits)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """The kept columns (all but the text by default) with n, form, prefix_chars, middle_chars and output.

    A text's units are its words, each with the white space before it, and white space at its end; n is their
    number. Two draws cut it between units, a third leaves it plain or not, a fourth chooses the order: psm has
    the suffix before the middle, spm the suffix first. Draws follow from the SHA-256 of seed and key alone, so a
    repeated row gets the same output. Empty and null texts (n 0) and texts that hold a mark are plain, with null
    counts of characters; a null key counts as an empty one. A kept column named as a new one is replaced.
    """
    new = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows, fields = carried(docs, [c for c in docs.columns if c != text] if keep is None else keep, [n for n, _ in new], [F.col(f"`{text}`"), *draws])
    m = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(m + 1 + k).to_numpy() for k in range(4)], axis=1) if batch.num_rows else None
            for data, offsets, first, end in text_chunks(batch.column(m)):
                n, form, before, between, out, bounds = rearranged(data, offsets, h[first:end], fim_percent, spm_percent)
                none = form == 0
                made = [pa.array(n), pa.array(FORMS[form], pa.string()), pa.array(before, mask=none), pa.array(between, mask=none), _strings(out, bounds)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:m], *made], names=names)

    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in new)])
    names = schema.names
    return rows.mapInArrow(run, schema)


def restore(coded: DataFrame, output: str = "output", form: str = "form", keep: list[str] | None = None, restored_as: str = "restored") -> DataFrame:
    """The kept columns (all but the output by default) with the exact text that output and form stand for.

    A null output or form, another form, or an output without the marks of its form gives null.
    """
    rows, fields = carried(coded, [c for c in coded.columns if c != output] if keep is None else keep, [restored_as], [F.col(f"`{output}`"), F.col(f"`{form}`")])
    m = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(m + 1).to_pylist()
            code = np.array([{"plain": 0, "psm": 1, "spm": 2}.get(f, -1) for f in forms], np.int64)
            null = batch.column(m).is_null().to_numpy(zero_copy_only=False)
            for data, offsets, first, end in text_chunks(batch.column(m)):
                known = (code[first:end] >= 0) & ~null[first:end]
                out, bounds, good = restored(data, offsets, np.where(known, code[first:end], 0))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:m], _strings(out, bounds, good & known)], names=names)

    schema = T.StructType([*fields, T.StructField(restored_as, T.StringType())])
    names = schema.names
    return rows.mapInArrow(run, schema)
