"""Language identification by a small convolutional network over bytes.

The network reads windows of WINDOW bytes of the lower-cased UTF-8 text. Filters of several widths slide
over the bytes (a byte's input is one-hot, so that a filter is a table of 256 rows for each of its
positions), each keeps its largest response in the window, and a softmax turns these into probabilities.
It is trained with numpy on a bounded sample of labelled rows and applied to every window of every text.

One more class stands for what is in none of the languages. Its windows are made: characters of the sample in
another order, random letters of several scripts, repeated pieces. A text's score is the share of its best
language among all classes, so it may fall to near 0 whatever the number of languages is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import carried, labelled_sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Steps of a weight of 1 when it is rounded to 16 bits for scoring.
STEPS = 512
#: Windows in no language that training makes for each text.
JUNK_EACH = 1
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteConvNet:
    """tables[w][j]: 256 x FILTERS weights of a width's position j; out, bias: the softmax layer, a column for each label and a last one for none of them."""

    labels: list[str]
    tables: list[np.ndarray]
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, and where it was."""
        found, places = [], []
        flat = windows.reshape(-1)
        for width, table in zip(WIDTHS, self.tables, strict=True):
            steps = windows.shape[1] - width + 1
            total = np.take(table[0], flat, axis=0).reshape(*windows.shape, FILTERS)[:, :steps].copy()
            for j in range(1, width):
                total += np.take(table[j], flat, axis=0).reshape(*windows.shape, FILTERS)[:, j : j + steps]
            at = total.argmax(axis=1)
            places.append(at)
            found.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(found, axis=1), np.concatenate(places, axis=1)

    def peak(self, windows: np.ndarray) -> np.ndarray:
        """Largest responses only. Weights are rounded to 16-bit steps; a window's positions run along the first axis."""
        size, n = windows.shape[1], windows.shape[0]
        flat = np.ascontiguousarray(windows.T).reshape(-1)
        found = []
        for width, table in zip(WIDTHS, self._rounded(), strict=True):
            steps = size - width + 1
            total = np.take(table[0], flat[: steps * n], axis=0)
            for j in range(1, width):
                total += np.take(table[j], flat[j * n : (j + steps) * n], axis=0)
            found.append(total.reshape(steps, n * FILTERS).max(axis=0).reshape(n, FILTERS))
        return np.concatenate(found, axis=1).astype(np.float32) / STEPS

    def _rounded(self) -> list[np.ndarray]:
        if not hasattr(self, "_steps"):
            self._steps = [np.clip(np.rint(t * STEPS), -8000, 8000).astype(np.int16) for t in self.tables]
        return self._steps

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.peak(windows) + self.shift, 0)
        logits = hidden @ self.out + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def as_windows(text: str) -> np.ndarray:
    """The whole text as rows of WINDOW bytes; the last is filled up with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    rows = max(1, -(-len(raw) // WINDOW))
    padded = np.zeros(rows * WINDOW, np.uint8)
    padded[: len(raw)] = raw
    return padded.reshape(rows, WINDOW)


def _junk(text: str, rng: np.random.Generator) -> str:
    """About WINDOW characters in no language."""
    kind, size = int(rng.integers(4)), WINDOW
    if kind == 0:  # the same characters in another order
        at = int(rng.integers(max(1, len(text) - size)))
        return "".join(rng.permutation(list(text[at : at + size])))
    if kind == 1:  # a piece over and over
        piece = "".join(chr(97 + k) for k in rng.integers(0, 26, int(rng.integers(1, 5))))
        return (piece + " " * int(rng.integers(2))) * size
    first, letters = ((97, 26), (97, 26), (0xDF, 32), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x627, 36), (0x905, 53), (0x3041, 86), (0x4E00, 20000), (0xAC00, 11000))[int(rng.integers(11))]
    gap = rng.random(size) < rng.choice([0.02, 0.15, 0.25])
    return "".join(" " if g else chr(first + k) for g, k in zip(gap, rng.integers(0, letters, size).tolist(), strict=True))


def train(rows: list[tuple[str, str]], windows_each: int = 4, epochs: int = 6, rate: float = 0.1, seed: int = 7) -> ByteConvNet | None:
    """Fits the network to (text, label) rows. Of a text, up to windows_each windows spread over the whole are used."""
    rows = [(t, y) for t, y in rows if _LETTER.search(t)]
    labels = sorted({y for _, y in rows})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, label in rows:
        all_windows = as_windows(text)
        full = max(1, len(text.encode("utf-8", "replace")) // WINDOW)
        for k in sorted({int(i) for i in np.linspace(0, full - 1, min(full, windows_each))}):
            window = all_windows[k].copy()
            if rng.random() < 0.5:  # short texts occur too
                window[int(rng.integers(8, WINDOW)) :] = 0
            xs.append(window)
            ys.append(labels.index(label))
        for _ in range(JUNK_EACH):
            window = as_windows(_junk(text, rng))[0]
            if rng.random() < 0.5:
                window[int(rng.integers(8, WINDOW)) :] = 0
            xs.append(window)
            ys.append(len(labels))
    x, y = np.stack(xs), np.array(ys)
    share = np.bincount(y, minlength=len(labels) + 1) / len(y)
    weight = (1 / ((len(labels) + 1) * share))[y]
    net = ByteConvNet(labels, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(labels) + 1)).astype(np.float32), np.zeros(len(labels) + 1, np.float32))
    for table in net.tables:
        table[:, 0] = -0.3  # filling has no say
    past = [np.full_like(a, 1e-3) for a in (*net.tables, net.shift, net.out, net.bias)]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            batch = x[pick]
            peak, place = net.pooled(batch)
            hidden = np.maximum(peak + net.shift, 0)
            logits = hidden @ net.out + net.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick][:, None] / len(pick)
            back = (p @ net.out.T) * (hidden > 0)
            steps = [*(np.zeros_like(t) for t in net.tables), back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            for k, width in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(width):
                    read = np.take_along_axis(batch, place[:, part] + j, axis=1)
                    np.add.at(steps[k][j], (read, np.arange(FILTERS)[None, :]), back[:, part])
            for value, step, seen in zip((*net.tables, net.shift, net.out, net.bias), steps, past, strict=True):
                seen += step * step
                value -= (rate * step / np.sqrt(seen)).astype(value.dtype)
    return net


def predict(net: ByteConvNet | None, texts: list[str | None], at_once: int = 64) -> tuple[list[str], list[float]]:
    """Best label and its probability, of each whole text: the mean over its windows, weighted by the bytes in them."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if net is None:
        return names, scores
    owners, blocks, held = [], [], 0
    totals = np.zeros((len(texts), len(net.labels) + 1))

    def flush() -> None:
        nonlocal held
        if blocks:
            windows, owner = np.concatenate(blocks), np.concatenate(owners)
            for k in range(0, len(windows), at_once):
                part = windows[k : k + at_once]
                np.add.at(totals, owner[k : k + at_once], net.probabilities(part) * np.count_nonzero(part, axis=1)[:, None])
            owners.clear()
            blocks.clear()
            held = 0

    for i, text in enumerate(texts):
        if text and any(m.group().isalpha() for m in _LETTER.finditer(text)):
            block = as_windows(text)
            blocks.append(block)
            owners.append(np.full(len(block), i))
            held += len(block)
            if held >= 16 * at_once:
                flush()
    flush()
    for i in np.flatnonzero(totals.sum(axis=1)):
        share = totals[i] / totals[i].sum()
        best = int(share[:-1].argmax())
        names[i], scores[i] = net.labels[best], float(min(1.0, share[best]))
    return names, scores


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", max_rows: int = 2400) -> ByteConvNet | None:
    """A network for the labels of rows, from at most max_rows of them, dealt evenly over the labels."""
    return train(labelled_sample(rows, rows, label, text, key, max_rows))


def identify(docs: DataFrame, net: ByteConvNet | None, text: str = "text", label_as: str = "lang_pred", score_as: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or only the columns `keep` of it) with the predicted label (`und` for null texts and those without a
    letter) and its probability.

    Existing columns of the two new names are replaced. An empty table gives an empty table; without any
    labelled row (net is None) every text is `und` with score 0. The text goes back to Spark only where it is kept.
    """
    source, fields = carried(docs, docs.columns if keep is None else keep, [label_as, score_as], [F.col(f"`{text}`")])
    schema = T.StructType([*fields, T.StructField(label_as, T.StringType(), False), T.StructField(score_as, T.DoubleType(), False)])
    names_out = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                names, scores = predict(net, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=names_out)

    return source.mapInArrow(run, schema)
