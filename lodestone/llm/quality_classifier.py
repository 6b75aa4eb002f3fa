"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Each coordinate keeps the sum of its gradients and of their squares (FTRL-proximal); weights follow from
these in closed form, and the L1 term leaves most of them at zero. Scores are sparse dot products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.hashed_lr import margins, row_features, sigmoid, word_families
from lodestone.llm.shared import carried, labelled_sample, text_chunks

BITS = 20
THRESHOLD = 0.3


@dataclass
class FtrlModel:
    """The weights of single words and of word pairs."""

    tables: list[np.ndarray]
    bias: float


class Ftrl:
    """FTRL-proximal with rate alpha / (beta + root of summed squares), L1 and L2 terms."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 0.01, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.lead, self.squares = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.lead[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.squares[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        grown = self.squares[at] + gradient * gradient
        self.lead[at] += gradient - (np.sqrt(grown) - np.sqrt(self.squares[at])) / self.alpha * weights
        self.squares[at] = grown


def train(rows: list[tuple[str, int]], epochs: int = 6, seed: int = 5) -> FtrlModel | None:
    """Fits to (text, 0 or 1) rows; None if only one label occurs."""
    if len({y for _, y in rows}) < 2:
        return None
    examples = []
    for data, offsets, first, end in text_chunks(pa.array([t for t, _ in rows], pa.string())):
        families = word_families(data, offsets, BITS)
        examples += [(row_features(families, i), rows[first + i][1]) for i in range(end - first)]
    learners = [Ftrl(1 << BITS), Ftrl(1 << BITS)]
    level = Ftrl(1, l1=0.0)
    one, rng = np.zeros(1, np.int64), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            example, y = examples[i]
            held = [learner.weights(at) for learner, (at, _) in zip(learners, example, strict=True)]
            bias = level.weights(one)
            error = float(sigmoid(np.array(bias[0] + sum(w @ x for w, (_, x) in zip(held, example, strict=True)))) - y)
            for learner, w, (at, x) in zip(learners, held, example, strict=True):
                learner.update(at, error * x, w)
            level.update(one, np.array([error]), bias)
    return FtrlModel([learner.weights().astype(np.float32) for learner in learners], float(level.weights(one)[0]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_rows: int = 4000) -> FtrlModel | None:
    """A model from at most max_rows labelled texts, and of either label at most 1,000 (labelled_sample's bound): 2,000 by default."""
    return train(labelled_sample(labels.where(F.col(label).isin(0, 1)), docs, label, text, key, max_rows))


def classify(docs: DataFrame, model: FtrlModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or only the columns `keep` of it) with score (0 to 1, higher: label 1 likelier) and predicted (1 from
    THRESHOLD on).

    Null texts score as empty ones, by the bias alone; without a model every score is 0.5. Existing columns of the
    two names are replaced; an empty table stays empty. The text goes back to Spark only where it is kept.
    """
    source, fields = carried(docs, docs.columns if keep is None else keep, ["score", "predicted"], [F.col(f"`{text}`")])
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, first, end in text_chunks(batch.column(batch.num_columns - 1)):
                score = np.full(end - first, 0.5) if model is None else sigmoid(margins(word_families(data, offsets, BITS), model.tables, model.bias))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:-1], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=names)

    return source.mapInArrow(run, schema)
