"""Helpers that several operators share: work folders, word scanning over Arrow buffers, model samples."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass handles, so that temporary arrays stay small.
CHUNK_BYTES = 1 << 19
#: Rows of one label in a sample at most.
MOST_PER_LABEL = 1000
#: How many times as many keys as wanted are ranked for a sample.
OVERSAMPLE = 4
#: The bytes that part words: space and \x09-\x0D.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary one; on a cluster that is an error, since executors
    could not read it. What jobs leave there (checkpoints, tables, archives) is the caller's to remove.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def work_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def carried(docs: DataFrame, keep: list[str], new: list[str], values: list[Column]) -> tuple[DataFrame, list[T.StructField]]:
    """The kept columns and then the values, under names of their own (k0, k1, .., v0, v1, ..), and the kept columns' fields.

    For kernels that go by position: no column of the table can clash with what a kernel needs or makes. Kept columns
    whose name (in any case of letters) is among the new ones are left out, as those replace them.
    """
    taken = {n.lower() for n in new}
    kept = [c for c in keep if c.lower() not in taken]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in kept]
    rows = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(quoted)], *[v.alias(f"v{i}") for i, v in enumerate(values)])
    return rows, [T.StructField(c, f.dataType, f.nullable) for c, f in zip(kept, rows.schema.fields, strict=False)]


@contextmanager
def without_collector() -> Iterator[None]:
    """Python's cycle collector is off inside: for loops that make millions of small objects without a cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def crc_mod(doc_id: str | Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(by)


def labelled_sample(labelled: DataFrame, docs: DataFrame, label: str, text: str, key: str, max_rows: int) -> list[tuple]:
    """At most max_rows (text, label) pairs for fitting a model, dealt evenly over the labels.

    Of each label the keys with the smallest hashes are taken, MOST_PER_LABEL at most, among all labelled keys that
    docs holds. Only keys whose hash is so small that a few times as many as wanted are expected get ranked; where
    docs holds too few of these, the bound is doubled until it takes in every key, so the choice never depends on it.
    Then the texts of the chosen keys are read. Null keys, labels and texts are left out; of rows that repeat a key
    the smallest label and text count. The labels themselves are collected: the model has a class for each.
    """
    usable = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(label).alias("_y"), F.xxhash64(key).alias("_h"))
    held = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"))
    wanted = min(max_rows, MOST_PER_LABEL)
    counts = {r[0]: r[1] for r in usable.groupBy("_y").count().collect()}
    share = {y: OVERSAMPLE * wanted / n for y, n in counts.items()}
    chosen: list[tuple] = []
    open_labels = set(counts)
    while open_labels:
        low = F.lit(False)
        for y in sorted(open_labels):
            low = low | ((F.col("_y") == F.lit(y)) & (F.lit(share[y] >= 1) | (F.col("_h") < F.lit(min((1 << 63) - 1, -(1 << 63) + int(min(share[y], 1.0) * (1 << 64)))))))
        few = usable.where(low).groupBy("_k", "_h").agg(F.min("_y").alias("_y")).join(held, "_k", "left_semi")
        ranked = few.withColumn("_n", F.row_number().over(Window.partitionBy("_y").orderBy("_h", "_k"))).where(F.col("_n") <= wanted)
        found = ranked.select("_n", "_h", "_k", "_y").collect()
        met = Counter(r["_y"] for r in found)
        done = {y for y in open_labels if met[y] >= wanted or share[y] >= 1}
        chosen += [tuple(r) for r in found if r["_y"] in done]
        open_labels -= done
        share = {y: 2 * s for y, s in share.items()}
    first = {k: y for _, _, k, y in sorted(chosen)[:max_rows]}
    if not first:
        return []
    texts = docs.where(F.col(key).isin(list(first)) & F.col(text).isNotNull()).groupBy(key).agg(F.min(text)).collect()
    return [(r[1], first[r[0]]) for r in sorted(texts)]


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, end row) of pieces of a text column of about `size` bytes; nulls count as empty.

    No text is cut: one that is longer than a chunk is a chunk of its own.
    """
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], first, end
        first = end


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                both.append(np.multiply.accumulate(table))
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of the first word of each row (with the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums: no loop over spans."""
    with np.errstate(over="ignore"):
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Longest span, in bytes, whose key is made from its 8-byte windows.
LONG_SPAN = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def window_reader(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function from spans (by number) and a place in them, before their end, to up to eight bytes from there on, as one number."""
    windows = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    return lambda k, j: windows[starts[k] + j] & _MASKS[np.minimum(ends[k] - starts[k] - j, 8)]


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit key of each byte span, equal for equal spans; another seed gives other keys."""
    n, part = ends - starts, window_reader(data, starts, ends)
    drawn = mix(np.array([seed], np.uint64))[0]
    with np.errstate(over="ignore"):
        key = mix(part(np.arange(len(n)), 0) ^ mix(n.astype(np.uint64) + drawn))
        more = np.flatnonzero(n > 8)
        for j in range(8, LONG_SPAN, 8):
            if not len(more):
                break
            key[more] = mix(key[more] + part(more, j))
            more = more[n[more] > j + 8]
    for k in np.flatnonzero(n > LONG_SPAN):
        key[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return key


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty spans give 0."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
