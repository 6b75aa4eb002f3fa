"""Token ids in files of fixed bit width, written in the order of the documents' keys and read at any place.

A file has a header (magic, bits, ids in a block, ids in all), blocks of ids, each id in the fewest bits that the vocabulary
needs, from the lowest bit up, then offset and CRC-32 of each block, and where that table begins. All blocks but the
last hold the same number of ids, so a place leads to its block, a block to its bytes, and numpy unpacks them at once.
Documents are encoded where they lie, dealt into ranges of their keys (ids only), and each range is one file. The index
has a row for each document; files of tasks that failed or ran twice are in no row of it, so nothing reads them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import pieces
from lodestone.llm.shared import carried, text_chunks, without_collector, work_folder

MAGIC = b"LSTOKID1"
_HEAD, _TABLE, _TAIL = struct.Struct("<8sIIQ"), np.dtype([("at", "<u8"), ("crc", "<u4")]), struct.Struct("<Q8s")
#: Ids in a block (a multiple of 8), ids that a reader unpacks at once, and pieces that a worker keeps.
BLOCK_IDS, MAX_IDS, MAX_PIECES = 4096, 1 << 20, 400_000
#: Bytes of text that are cut at once: many, since equal pieces among them are looked up once.
CHUNK = 2 << 20
#: Bytes of text that make a file, and the most files.
FILE_BYTES, MOST_FILES = 32 << 20, 16_384
INDEX = "key long, file string, shard int, first long, n_tokens long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, the first in the lowest bits of the first byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.ravel()[: len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for k in range(8):  # eight ids fill `bits` bytes
        byte, shift = divmod(k * bits, 8)
        value = groups[:, k] << np.uint64(shift)
        for j in range(-(-(shift + bits) // 8)):
            out[:, byte + j] |= (value >> np.uint64(8 * j)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids that pack() gave these bytes for."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    groups = np.zeros((-(-n // 8), bits), np.uint8)
    groups.ravel()[: len(raw)] = np.frombuffer(raw, np.uint8)[: groups.size]
    out = np.empty((len(groups), 8), np.uint32)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = np.zeros(len(groups), np.uint64)
        for j in range(-(-(shift + bits) // 8)):
            value |= groups[:, byte + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.ravel()[:n]


class Writer:
    """Writes ids to an open stream, block by block as they come."""

    def __init__(self, stream, bits: int, block: int = BLOCK_IDS):
        self.stream, self.bits, self.block = stream, bits, block
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.at, self.table = _HEAD.size, []
        stream.write(_HEAD.pack(MAGIC, bits, block, 0))

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id does not fit in {self.bits} bits")
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.block:
            self._blocks(self.waiting // self.block * self.block)

    def _blocks(self, n: int) -> None:
        ids = np.concatenate(self.held)
        self.held, self.waiting = [ids[n:]], len(ids) - n
        raw, size = pack(ids[:n], self.bits), -(-self.block * self.bits // 8)
        for low in range(0, len(raw), size):
            self.table.append((self.at + low, zlib.crc32(raw[low : low + size])))
        self.at += len(raw)
        self.stream.write(raw)

    def close(self) -> None:
        if self.waiting:
            self._blocks(self.waiting)
        self.stream.write(np.array(self.table, _TABLE).tobytes() + struct.pack("<Q", self.total) + _TAIL.pack(self.at, MAGIC))
        self.stream.close()


class Reader:
    """Ids at any place of a file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block, _ = _HEAD.unpack(self._read(0, _HEAD.size))
        end = size - _TAIL.size - 8
        (self.total,) = struct.unpack("<Q", self._read(end, 8))
        at, again = _TAIL.unpack(self._read(end + 8, _TAIL.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError("this is no file of token ids, or it is not whole")
        self.table = np.frombuffer(self._read(at, end - at), _TABLE)
        self.ends = np.append(self.table["at"][1:], np.uint64(at))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, n: int) -> np.ndarray:
        """The n ids from place `first` on, from one read of their blocks; a block that is damaged ends the job."""
        if not 0 <= first <= first + n <= self.total:
            raise ValueError("the file does not have these ids")
        if not n:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, (first + n - 1) // self.block + 1
        begin = int(self.table["at"][low])
        raw = self._read(begin, int(self.ends[high - 1]) - begin)
        for (at, crc), end in zip(self.table[low:high].tolist(), self.ends[low:high].tolist(), strict=True):
            if zlib.crc32(raw[at - begin : end - begin]) != crc:
                raise ValueError(f"the block at {at} is damaged")
        held = unpack(raw, min(high * self.block, self.total) - low * self.block, self.bits)
        return held[first - low * self.block :][:n]


class Encoder(dict):
    """Ids of pieces by the model of a byte-level tokenizer file. When full, it becomes the older half of what is kept."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.older = self.tokenizer.model, {}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.signs = {b: chr(256 + k) for k, b in enumerate(rest)}  # byte-level alphabet: the other bytes are their own signs
        self.bits = bits_for(self.tokenizer.get_vocab_size(with_added_tokens=True))

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= MAX_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            found = self.model.tokenize(piece.decode("latin-1").translate(self.signs))
            ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        self[piece] = ids
        return ids

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with without_collector():
            return pieces.encoded(data, offsets, lambda p: list(map(self.__getitem__, p)), self.whole, b"<|")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file in a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _ranges(docs: DataFrame, key: str, text: str) -> list[int]:
    """Keys that part the rows evenly into as many ranges as files are wanted; a key that fills ranges is there repeatedly."""
    found = docs.agg(F.sum(F.octet_length(F.col(text))).alias("bytes"), F.count(key).alias("rows")).first()
    wanted = min(MOST_FILES, -(-(found["bytes"] or 0) // FILE_BYTES), found["rows"])
    if wanted < 2:
        return []
    return docs.agg(F.percentile_approx(key, [k / wanted for k in range(1, wanted)], 10 * wanted)).first()[0]


def write(docs: DataFrame, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Writes the ids of all whole texts, each followed by end_id, in ascending order of the keys (null first), and
    returns their index, read from its table: key, file, place in the file, number of ids, and start, the ids before it in all.

    path: a byte-level tokenizer file that every executor has; strings of its special tokens in a text are those tokens, as in
    the library. A null text is empty and has end_id alone. Keys are cast to long. Rows of equal keys follow each other
    in the order of a hash of their ids, and may lie in several files. No row gives no file and an empty index.
    """
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "token-ids")
    named = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    bounds = np.array(_ranges(named, "key", "text"), np.int64)
    rows, _ = carried(named, [], [], [F.col("key"), F.col("text")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for data, offsets, first, end in text_chunks(batch.column(1), CHUNK):
                ids, at = own.encode(data, offsets)
                out = np.full(len(ids) + end - first, end_id, np.uint32)
                ends = at[1:] + np.arange(end - first)
                inside = np.ones(len(out), bool)
                inside[ends] = False
                out[inside] = ids
                raw = out.astype("<u2" if own.bits <= 16 else "<u4")
                places = np.concatenate([[0], ends + 1]) * raw.itemsize
                keys = batch.column(0).slice(first, end - first)
                values = keys.fill_null(0).to_numpy()
                low, high = np.searchsorted(bounds, values), np.searchsorted(bounds, values, side="right")
                marks = np.array([zlib.crc32(raw[a : b + 1].tobytes()) for a, b in zip(np.concatenate([[0], ends[:-1] + 1]), ends, strict=True)], np.int64)
                shard = np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, low + marks % (high - low + 1))  # a key that fills ranges is dealt over them
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), keys, pa.array(marks), held.cast(pa.binary())], names=["shard", "key", "mark", "ids"])

    coded = rows.mapInArrow(encode, "shard int, key long, mark long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "mark", "ids")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = encoder(path).bits
        system, base = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(f"{base}/files", recursive=True)
        out, of, name = None, None, None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else [0]
            for low, high in zip(cuts, cuts[1:]):
                if of != shards[low]:
                    if out is not None:
                        out.close()
                    of, name = shards[low], f"{base}/files/part-{uuid.uuid4().hex}.ids"
                    out = Writer(system.open_output_stream(name, compression=None), bits)
                sizes = []
                begin = out.total
                for raw in batch.column(3).slice(low, high - low):
                    ids = np.frombuffer(raw.as_buffer(), "<u2" if bits <= 16 else "<u4")
                    out.add(ids)
                    sizes.append(len(ids))
                n = np.array(sizes, np.int64)
                own = pa.array([name] * len(n), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), own, batch.column(0).slice(low, high - low), pa.array(begin + np.cumsum(n) - n), pa.array(n)], names=["key", "file", "shard", "first", "n_tokens"])
        if out is not None:
            out.close()

    dealt.mapInArrow(save, INDEX).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = index.join(F.broadcast(starts), "shard")  # MOST_FILES rows at most
    return placed.select("key", F.lit(folder).alias("folder"), "file", "first", "n_tokens", (F.col("_start") + F.col("first")).alias("start"))


def read(index: DataFrame) -> DataFrame:
    """key, start, n_tokens and ids (little-endian unsigned 32-bit) of the documents of these index rows, from the files.

    Any rows of an index can be read; neighbours are read together. A damaged file ends the job.
    """
    held = index.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(1, min(MOST_FILES, -(-held // (8 * MAX_IDS))))
    rows = index.select("folder", "file", "first", "n_tokens", "key", "start").repartitionByRange(tasks, "file", "first").sortWithinPartitions("file", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, opened, reader = None, None, None
        for batch in batches:
            files, first, n = batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            low = 0
            while low < len(files):
                high, end = low + 1, first[low] + n[low]
                while high < len(files) and files[high] == files[low] and first[high] <= end and first[high] + n[high] - first[low] <= MAX_IDS:
                    end = max(end, first[high] + n[high])
                    high += 1
                if files[low] != opened:
                    system = system or pa.fs.FileSystem.from_uri(batch.column(0)[low].as_py())[0]
                    reader, opened = Reader(system.open_input_file(files[low])), files[low]
                ids = reader.ids(int(first[low]), int(end - first[low])).astype("<u4")
                own = [ids[a : a + k].tobytes() for a, k in zip(first[low:high] - first[low], n[low:high], strict=True)]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), part.column(3), pa.array(own, pa.binary())], names=["key", "start", "n_tokens", "ids"])
                low = high

    return rows.mapInArrow(run, "key long, start long, n_tokens long, ids binary")
