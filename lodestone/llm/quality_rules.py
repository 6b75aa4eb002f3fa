"""Quality rules: counted rules and a calibrated n-gram model against fixed thresholds.

The counted rules reject texts that are very short or mostly made of repeated passages. A logistic
regression over hashed word and character n-grams, fitted to labelled rows and calibrated on a part of them kept
apart, judges the rest. Scoring runs over Arrow batches with numpy; every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.hashed_lr import Family, character_families, margins, row_features, sigmoid, word_families
from lodestone.llm.shared import IS_SPACE, carried, labelled_sample, mix, span_hashes, text_chunks, words_of

#: Fixed thresholds.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW_WORDS, MIN_QUALITY = 20, 30, 8, 0.3
SYMBOLS = "#*$%&|<>"
BITS = 18
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


@dataclass
class QualityModel:
    """A weight table for each feature family, and the calibration p = sigmoid(slope * margin + offset)."""

    tables: list[np.ndarray]
    bias: float
    slope: float = 1.0
    offset: float = 0.0


def features(data: np.ndarray, offsets: np.ndarray, **words) -> Iterator[Family]:
    """The families of a model's features, one at a time."""
    yield from word_families(data, offsets, BITS, **words)
    yield from character_families(data, offsets, BITS)


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The counts of each row, and the word hashes they were taken from."""
    rows = len(offsets) - 1
    if not len(data):  # nothing but empty texts
        none = np.zeros(rows, np.int64)
        return dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), none), {"hashes": np.zeros(0, np.uint64), "first": np.zeros(rows + 1, np.int64)}
    starts, ends, first = words_of(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n_words = np.diff(first)

    def inside(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    chars = inside(~IS_SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = inside(_IS_SYMBOL[data])

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    ended = (data[line_ends - 1] == 10) if len(line_ends) else np.zeros(0, bool)
    line_ends = line_ends - ended
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
    with np.errstate(over="ignore"):
        keyed = mix(span_hashes(data, line_starts, line_ends) + line_rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one = np.unique(keyed, return_index=True)
    dup_lines = np.bincount(line_rows, minlength=rows) - np.bincount(line_rows[one], minlength=rows)

    repeat_words = np.zeros(rows, np.int64)
    n = len(hashes) - WINDOW_WORDS + 1
    if n > 0:
        word_rows = np.repeat(np.arange(rows), n_words)
        whole = np.flatnonzero(word_rows[:n] == word_rows[WINDOW_WORDS - 1 :])
        with np.errstate(over="ignore"):
            run = word_rows[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for j in range(WINDOW_WORDS):
                run = run * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
            run = mix(run[whole])
        order = np.argsort(run)
        same = run[order][1:] == run[order][:-1]
        again = np.zeros(len(run), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        marks = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(marks, whole[again], 1)
        np.add.at(marks, whole[again] + WINDOW_WORDS, -1)
        repeat_words = np.bincount(word_rows[np.cumsum(marks[:-1]) > 0], minlength=rows)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words}, {"hashes": hashes, "first": first}


def train(rows: list[tuple[str, int]], good_share: float, epochs: int = 8, rate: float = 0.5, ridge: float = 1e-6, seed: int = 11) -> QualityModel | None:
    """Fits to (text, 0 or 1) rows; every third row only serves the calibration. good_share: of 1 among all labelled rows."""
    if len({y for _, y in rows}) < 2:
        return None
    column = pa.array([t for t, _ in rows], pa.string())
    examples = []
    for data, offsets, first, end in text_chunks(column):
        families = list(features(data, offsets))
        examples += [(row_features(families, i), rows[first + i][1]) for i in range(end - first)]
    tables = [np.zeros(1 << BITS) for _ in range(4)]
    seen = [np.full(1 << BITS, 1e-8) for _ in range(4)]
    bias, bias_seen = 0.0, 1e-8
    fitted, apart = [e for i, e in enumerate(examples) if i % 3], examples[::3]
    rng = np.random.default_rng(seed)

    def margin(example: list) -> float:
        return bias + sum(float(table[at] @ x) for table, (at, x) in zip(tables, example, strict=True))

    for _ in range(epochs):
        for i in rng.permutation(len(fitted)):
            example, y = fitted[i]
            error = float(sigmoid(np.array(margin(example))) - y)
            for table, past, (at, x) in zip(tables, seen, example, strict=True):
                step = error * x + ridge * table[at]
                past[at] += step * step
                table[at] -= rate * step / np.sqrt(past[at])
            bias_seen += error * error
            bias -= rate * error / np.sqrt(bias_seen)
    z, y = np.array([margin(e) for e, _ in apart]), np.array([y for _, y in apart], float)
    slope, offset = 1.0, 0.0
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):  # Newton steps of a two-parameter logistic fit
        p = sigmoid(slope * z + offset)
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - goal) * z).sum(), (p - goal).sum()])
        hessian = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(hessian, gradient)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-8:
            break
    own = min(0.99, max(0.01, float(np.mean([y for _, y in rows]))))
    share = min(0.99, max(0.01, good_share))
    return QualityModel([t.astype(np.float32) for t in tables], float(bias), float(slope), float(offset + np.log(share / (1 - share)) - np.log(own / (1 - own))))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_rows: int = 2400) -> QualityModel | None:
    """A model from at most max_rows labelled texts, as many of either label as there are; None if only one label occurs."""
    known = labels.where(F.col(label).isin(0, 1))
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    rows = labelled_sample(known, docs, label, text, key, max_rows)
    return train(rows, counts.get(1, 0) / max(1, sum(counts.values())))


#: What judge() adds.
ADDED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("quality", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


def judge(docs: DataFrame, model: QualityModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or only the columns `keep` of it) with its counts, the model's probability of good quality, base_failed
    and kept.

    A null text has no words and so fails, as an empty one does. Without a model the probability is null and the
    counted rules alone decide. Existing columns of the added names are replaced; an empty table stays empty. The
    text itself goes back to Spark only where it is among the kept columns.
    """
    source, fields = carried(docs, docs.columns if keep is None else keep, ADDED.names, [F.col(f"`{text}`")])
    schema = T.StructType([*fields, *ADDED.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, first, end in text_chunks(batch.column(batch.num_columns - 1)):
                counts, words = counted(data, offsets)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                good = None
                if model is not None:
                    good = sigmoid(model.slope * margins(features(data, offsets, **words), model.tables, model.bias) + model.offset)
                kept = ~failed if good is None else ~failed & (good >= MIN_QUALITY)
                added = [*(pa.array(counts[f.name], pa.int64()) for f in ADDED.fields[:5]), pa.nulls(end - first, pa.float64()) if good is None else pa.array(good), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:-1], *added], names=names)

    return source.mapInArrow(run, schema)
