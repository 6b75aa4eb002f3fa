"""Packing of token sequences into windows of a fixed length by non-negative least squares.

Documents are packed block by block as their partition is read, so nothing is shuffled and a task holds one
block at a time. In a block, full windows are cut from long documents. The lengths of what is left form a
histogram in UNITS classes. All shallow combinations of classes that fill a window exactly are enumerated, and
their repeat counts are the non-negative least-squares solution against the histogram, rounded down. Documents
left over are packed greedily: cut to fill what rounding up to classes left open, then into windows of their
own. What does not fill a window goes on to the partition's next block; only its last window is not full.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lodestone.llm.shared import without_collector

WINDOW, UNITS, DEPTH = 2048, 32, 4
#: Tokens of a block.
BLOCK_TOKENS = 4_000_000
MAX_PIECES, MAX_LENGTH = 300_000, 64
#: A tokenizer's rules for which words can be cut here, and its BPE model asked for one word at a time.
_KNOWN = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: In texts without these characters the standard library's classes are those of the rules, and NFC changes nothing.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]|<\\|")


class WordIds(dict):
    """Ids (as the bytes of unsigned 32-bit numbers) of what stands between two spaces of the lower-cased text, and of its
    words; when full, it becomes the older half of what is kept. Long ones are not kept."""

    def __init__(self, model):
        super().__init__()
        self.model, self.older = model, {}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.signs = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}  # byte-level alphabet

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            words = _WORD.findall(run)
            if words == [run]:
                ids = array("I", [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.signs))]).tobytes()
            else:
                ids = b"".join(map(self.__getitem__, words))
        if len(run) <= MAX_LENGTH:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[run] = ids
        return ids


@lru_cache(maxsize=4)
def tokenize(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to the ids that the tokenizer file gives it, without special tokens around them."""
    tokenizer = Tokenizer.from_file(path)
    rules = json.loads(tokenizer.to_str())
    steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
    cuts = [p.get("pattern", {}).get("Regex") for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
    words = WordIds(tokenizer.model) if (steps, cuts[:1]) == (_KNOWN[0], [_KNOWN[1]]) else None

    def ids(text: str) -> np.ndarray:
        if words is None or _ODD.search(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        # no word of the rules holds a space, so the text is cut at its spaces first
        return np.frombuffer(b"".join(map(words.__getitem__, text.lower().split())), np.uint32)

    return ids


def combinations_filling(units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every way to write `units` as a sum of at most `depth` classes, largest first."""
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(parts)
        elif len(parts) < depth:
            for part in range(min(left, parts[-1] if parts else left), 0, -1):
                extend((*parts, part), left - part)

    extend((), units)
    return found


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with the smallest |a x - b|, by an active set that grows by the steepest coordinate."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while True:
            held = np.flatnonzero(active)
            goal = np.linalg.lstsq(a[:, held], b, rcond=None)[0]
            if goal.min() > 0:
                x[:] = 0
                x[held] = goal
                break
            low = goal <= 0
            step = np.min(x[held][low] / np.maximum(x[held][low] - goal[low], 1e-12))
            x[held] += step * (goal - x[held])
            x[held[x[held] <= 1e-9]] = 0
            gone = held[(x[held] <= 1e-9)]
            if not len(gone):
                break
            active[gone] = False
            if not active.any():
                break
    return x


@lru_cache(maxsize=8)
def _ways(units: int, depth: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    ways = combinations_filling(units, depth)
    matrix = np.zeros((units, len(ways)))
    for k, way in enumerate(ways):
        for part in way:
            matrix[part - 1, k] += 1
    return ways, matrix


def plan(lengths: list[int], window: int = WINDOW) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows as lists of (document, start, length), and the pieces that are left and fill no window."""
    if window < UNITS:
        raise ValueError(f"a window has at least {UNITS} tokens")
    windows: list[list[tuple[int, int, int]]] = []
    classes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    unit = window // UNITS
    for i, n in enumerate(lengths):
        full = n // window
        windows += [[(i, k * window, window)] for k in range(full)]
        if rest := n - full * window:
            classes[-(-rest // unit)].append((i, full * window, rest))
    ways, matrix = _ways(UNITS, DEPTH)
    counts = np.array([len(classes[c]) for c in range(1, UNITS + 1)], float)
    repeats = np.floor(non_negative_least_squares(matrix, counts) + 1e-6).astype(int) if counts.any() else np.zeros(len(ways), int)
    combined: list[list[tuple[int, int, int]]] = []
    for k in np.argsort(-repeats, kind="stable"):
        for _ in range(repeats[k]):
            need = defaultdict(int)
            for part in ways[k]:
                need[part] += 1
            if any(len(classes[c]) < m for c, m in need.items()):
                break
            combined.append([classes[part].pop() for part in ways[k]])
    left = [p for c in sorted(classes, reverse=True) for p in classes[c]]
    combined.sort(key=lambda pieces: sum(p[2] for p in pieces))
    spare, open_room = sum(p[2] for p in left), sum(window - sum(p[2] for p in pieces) for pieces in combined)
    undone = 0
    while spare < open_room and undone < len(combined):  # take the emptiest apart until the rest can be filled
        held = sum(p[2] for p in combined[undone])
        spare, open_room = spare + held, open_room - (window - held)
        left += combined[undone]
        undone += 1
    stream = iter(left)
    piece = next(stream, None)

    def fill(room: int) -> list[tuple[int, int, int]]:
        nonlocal piece
        taken = []
        while room and piece:
            doc, start, n = piece
            cut = min(n, room)
            taken.append((doc, start, cut))
            room -= cut
            piece = (doc, start + cut, n - cut) if cut < n else next(stream, None)
        return taken

    for pieces in combined[undone:]:
        windows.append(pieces + fill(window - sum(p[2] for p in pieces)))
    while piece:
        taken = fill(window)
        if sum(p[2] for p in taken) < window:
            return windows, taken
        windows.append(taken)
    return windows, []


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents: key, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id
    and offset.

    A document's ids are those of the tokenizer file at `path` (which every executor has) and end_id; a null text
    has end_id alone. Every id lies in one piece and every sequence but the last of a partition has `window` ids.
    Rows that repeat are packed as often as they occur; an empty table gives no pieces.
    """
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = source.schema["_key"].dataType
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenize(path)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (key, ids, first position, tokens of the document)
        tokens, key_type = 0, None

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, number
            windows, rest = plan([len(h[1]) for h in held], window)
            if last and rest:
                windows.append(rest)
            for k in range(0, len(windows), 256):
                rows = []
                for pieces in windows[k : k + 256]:
                    offset = 0
                    for doc, start, n in pieces:
                        own, ids, first, total = held[doc]
                        rows.append((own, first + start, n, ids[start : start + n].astype("<u4").tobytes(), total, number, offset))
                        offset += n
                    number += 1
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=schema.names)
            held = [(held[d][0], held[d][1][s : s + n].copy(), held[d][2] + s, held[d][3]) for d, s, n in rest]
            tokens = sum(len(h[1]) for h in held)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                with without_collector():
                    for own, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        ids = np.append(ids_of(words), np.uint32(end_id)) if words else np.array([end_id], np.uint32)
                        held.append((own, ids, 0, len(ids)))
                        tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield from block(False)
        if held:
            yield from block(True)

    return source.mapInArrow(run, schema)
