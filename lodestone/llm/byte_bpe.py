"""Byte-level BPE as a finite-state transducer that is determinised as it is used.

A BPE result is a token sequence in which each pair of neighbours, merged on its own, falls apart into the
same two tokens. So the result of a prefix ends with exactly one token, and after some bytes the only open
question is where among the last few bytes a token ends. A state is what that leaves to remember: the last
token that is certain, and the bytes since. A transition reads a byte, drops the token ends from which no
token can go on, and emits the tokens on which all others agree. States and transitions are worked out when
first met and kept up to a bound. Decoding joins the tokens' bytes and runs them, block by block, through a
UTF-8 state machine that carries an unfinished character over to the next block.
"""

from __future__ import annotations

import base64
import codecs
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import pieces
from lodestone.llm.shared import carried, text_chunks, without_collector

#: Bounds of what a worker keeps; at a bound it forgets all and starts anew.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 200_000, 300_000, 200_000
#: Bytes of text that are cut at once: many, since equal pieces among them are looked up once.
CHUNK = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Turns the bytes of a piece into token ids, left to right."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.openings = {t[:k] for t in ranks for k in range(1, len(t))}
        self.sorted = sorted(ranks)
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.alike: dict[tuple, int] = {}
        self.over: dict[tuple[bytes, bytes], list[int]] = {}
        self._state(b"", [(-1, -1)], [0])

    def _edges(self, token: int) -> tuple[list, list] | None:
        """How merges build the token at its right and at its left edge: the growing edge parts, each with the
        rank that ends it. None if merging does not lead to the token at all."""
        if token in self.edges:
            return self.edges[token]
        raw = self.tokens[token]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        right, left = [], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                self.edges[token] = None
                return None
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            if at == 0:
                left.append((parts[0], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = self.edges[token] = ([*right, (raw, 1 << 41)], [*left, (raw, 1 << 41)])
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether the token right can stand after left (-1: at the start).

        Both tokens grow at their common border as merges come in the order of rank; they stay apart unless a
        merge over the border comes before the merges that end the two parts beside it.
        """
        key = (left + 1) * 1_000_003 + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        after = self._edges(right)
        if after is None or left < 0:
            return after is not None
        xs, ys = self._edges(left)[0], after[1]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            over = self.ranks.get(x + y)
            if over is not None and over < x_ends and over <= y_ends:
                return False
            if i == len(xs) - 1 and j == len(ys) - 1:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _state(self, since: bytes, last: list[tuple[int, int]], alive: list[int]) -> int:
        """last[i]: the last token of the first i bytes of `since`, and where it starts; alive: where a token may still begin."""
        key = (last[0][0], since)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append((since, last, alive))
        return number

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        since, last, alive = self.states[state]
        since += bytes((byte,))
        n = len(since)
        ended, still = (-1, -1), []
        for start in alive:
            tail = since[start:]
            if ended[1] < 0 and (found := self.ranks.get(tail)) is not None and self.follows(last[start][0], found):
                ended = (found, start)
            if tail in self.openings:
                still.append(start)
        last = [*last, ended]
        if ended[1] >= 0:
            still.append(n)
        base = still[0]
        for i in still:  # the last token end that all open ways share
            while i != base:
                if i > base:
                    i = last[i][1]
                else:
                    base = last[base][1]
        sent = ()
        if base:
            sent, last = self._way(last, base), [(last[base][0], -1), *((t, s - base) if s >= base else (-1, -1) for t, s in last[base + 1 :])]
            since, still = since[base:], [i - base for i in still]
        if since and last[0][0] >= 0:
            last[0] = (self._stands_for(last[0][0], since), -1)
        move = self.moves[state << 8 | byte] = (self._state(since, last, still), sent)
        return move

    def _stands_for(self, token: int, since: bytes) -> int:
        """A token that bars the same tokens from following among those that agree with the bytes `since`; -1 if it bars none.

        What a token bars depends on the merges over the border that come before its edge parts end.
        """
        early = []
        for x, ends in self._edges(token)[0]:
            over = self.over.get((x, since))
            if over is None:
                if len(self.over) >= MAX_PAIRS:
                    self.over.clear()
                over = self.over[x, since] = self._merges_over(x, since)
            if over and (n := bisect_left(over, ends)):
                early.append((x, n))
        return self.alike.setdefault((since, tuple(early)), token) if early else -1

    def _merges_over(self, x: bytes, since: bytes) -> list[int]:
        """The sorted ranks of x with a first part of `since`, or with something that starts with it."""
        whole = x + since
        found = [self.ranks[whole[:k]] for k in range(len(x) + 1, len(whole)) if whole[:k] in self.ranks]
        if whole in self.ranks or whole in self.openings:
            at = bisect_left(self.sorted, whole)
            while at < len(self.sorted) and self.sorted[at].startswith(whole):
                found.append(self.ranks[self.sorted[at]])
                at += 1
        return sorted(found)

    @staticmethod
    def _way(last: list[tuple[int, int]], end: int) -> tuple[int, ...]:
        """The tokens up to the byte `end`."""
        if not last[end][1]:
            return (last[end][0],)
        way = []
        while end > 0:
            token, end = last[end]
            way.append(token)
        return tuple(reversed(way))

    def ids(self, piece: bytes) -> list[int]:
        """The ids of a piece; one that is a token as a whole is that token, as the rank files are used."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._forget()
        sent: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                sent += move[1]
        since, last, _ = self.states[state]
        return [*sent, *self._way(last, len(since))] if since else sent


class Pieces(dict):
    """Ids (little-endian, 32 bits each) by piece, worked out when first asked for. When full, it becomes the older half of what is kept."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= MAX_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            found = self.transducer.ids(piece)
            ids = struct.pack(f"<{len(found)}I", *found)
        self[piece] = ids
        return ids


class Encoder:
    """Cuts texts into pieces by a pattern and encodes each piece by itself.

    Texts of plain characters are cut a chunk at a time where the pattern is the one that numpy cuts; others one by one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = Pieces(Transducer(ranks))
        self.pattern, self.known = regex.compile(pattern), pattern == pieces.PATTERN

    def ids_of(self, found: list[bytes]) -> list[bytes]:
        return list(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.ids_of([p.encode("utf-8", "replace") for p in self.pattern.findall(text)])), "<u4")

    def encode_rows(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(ids, where each row's begin and all end, first row, end row) for parts of a column of texts; null is empty."""
        for data, offsets, first, end in text_chunks(column, CHUNK):
            with without_collector():
                if self.known:
                    ids, bounds = pieces.encoded(data, offsets, self.ids_of, self.encode)
                else:
                    parts = [self.encode(data[a:b].tobytes().decode()) for a, b in zip(offsets, offsets[1:])]
                    ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            yield ids.astype(np.int32), bounds, first, end


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


_ELEMENT = pa.list_(pa.field("element", pa.int32(), False))


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)).cast(_ELEMENT)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each whole text instead of the text; a null text has none, as an empty one.

    path: a .tiktoken file that every executor has. An existing column of the new name is replaced.
    """
    rows, fields = carried(docs, docs.columns, [text, ids], [F.col(f"`{text}`")])
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for found, bounds, first, end in own.encode_rows(batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:-1], _lists(found, bounds)], names=names)

    return rows.mapInArrow(run, schema)


class Decoder:
    """The bytes of ids, as one array from which numpy gathers, and a UTF-8 state machine over them."""

    def __init__(self, tokens: dict[int, bytes]):
        self.lengths = np.zeros(max(tokens, default=0) + 1, np.int64)
        for i, token in tokens.items():
            self.lengths[i] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.all = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.lengths))), np.uint8)

    def raw(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.all[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def stream(self, blocks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of blocks of ids as they come. Bytes of a character not yet complete wait for the next block."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield machine.decode(self.raw(ids))
        yield machine.decode(b"", final=True)


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded", block: int = 65536) -> DataFrame:
    """coded with the text that its ids stand for instead of the ids; null ids give an empty text."""
    rows, fields = carried(coded, coded.columns, [ids, text], [F.col(f"`{ids}`")])
    schema = T.StructType([*fields, T.StructField(text, T.StringType(), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder({i: t for t, i in read_ranks(path).items()})
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = []
                for row in part.column(part.num_columns - 1):
                    flat = row.values.to_numpy() if row.is_valid else np.zeros(0, np.int32)
                    texts.append("".join(own.stream(flat[i : i + block] for i in range(0, len(flat), block))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", block: int = 65536) -> DataFrame:
    """docs with the ids of each whole text, and the text that these ids decode to, instead of the text.

    Both steps are those of encode() and decode(); done in one pass, the ids need not go to Python again.
    """
    rows, fields = carried(docs, docs.columns, [text, ids, decoded], [F.col(f"`{text}`")])
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        machine = Decoder(coder.pieces.transducer.tokens)
        for batch in batches:
            for found, bounds, first, end in coder.encode_rows(batch.column(batch.num_columns - 1)):
                texts = ["".join(machine.stream(found[i : min(i + block, b)] for i in range(a, b, block))) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:-1], _lists(found, bounds), pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(run, schema)
