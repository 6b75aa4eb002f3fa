"""Token-id files against the tokenizers library, and the way back from any place."""

import io
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import pieces, token_files
from lodestone.llm import queries as Q

PATH = P.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n ", "a", "It's 12³ ½ don't we'll they've I'd\t\r\n  x  ", "'s's 'tis rock'n'roll ''s \t's", "日本語 テキスト 😀 'll", "a\x00b\x0bc d", "\x1c's\x1d'll\x85 \xa0x", "<|endoftext|> inside <|", "x" * 90_000, "wörd " * 30_000, "same", "same", "ȁɏ ɐ"]


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_query_by_the_library(spark):
    tokenizer, start = Tokenizer.from_file(PATH), 0
    found = {r["doc_id"]: r for r in Q.op12_token_files(spark, SMALL).collect()}
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert len(found) == len(docs)
    for key, text in docs:
        ids = plain(tokenizer, text)
        assert found[key][1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("file_bytes", [1 << 25, 3000])
def test_odd_texts_repeated_and_null_keys_in_order(spark, monkeypatch, tmp_path, file_bytes):
    monkeypatch.setattr(token_files, "FILE_BYTES", file_bytes)
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no key"), (None, None)] + [(7, f"of the hot key {i}") for i in range(60)]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(t, k, "x", 1, 2) for k, t in rows], "text string, doc_id long, ids string, shard int, `key` int").repartition(5)
    index = token_files.write(docs, PATH, folder=f"file://{tmp_path}/out")
    found = sorted(token_files.read(index).collect(), key=lambda r: r["start"])
    assert [r["key"] for r in found] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    want, got, start = defaultdict(list), defaultdict(list), 0
    for key, text in rows:
        want[key].append(plain(tokenizer, text))
    for r in found:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
        got[r["key"]].append(np.frombuffer(r["ids"], "<u4").tolist())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    files = index.select("file").distinct().count()
    assert files == len(os.listdir(tmp_path / "out/files")) and (files > 3) == (file_bytes == 3000)
    if file_bytes == 3000:
        assert index.where("key = 7").select("file").distinct().count() > 1  # the hot key is not one task's
    few = index.where("key IN (3, 9)")
    assert {r["key"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read(few).collect()} == {k: want[k][0] for k in (3, 9)}


def test_an_empty_table(spark):
    index = token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert index.count() == 0 and token_files.read(index).count() == 0


@pytest.mark.parametrize("bits", range(1, 33))
def test_packing_of_every_width(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 4096, 5001):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        raw = token_files.pack(ids, bits)
        assert len(raw) == -(-n * bits // 8) and (token_files.unpack(raw, n, bits) == ids).all()
        assert int.from_bytes(raw, "little") == sum(int(x) << (bits * i) for i, x in enumerate(ids)) if n < 10 else True


class Kept(io.BytesIO):
    def close(self):
        pass

    def size(self):
        return len(self.getvalue())


def test_any_place_is_read_and_damage_is_seen():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_257, 10_000).astype(np.uint32)
    stream = Kept()
    writer = token_files.Writer(stream, 17, block=64)
    at = 0
    while at < len(ids):
        n = int(rng.integers(0, 300))
        writer.add(ids[at : at + n])
        at += n
    writer.close()
    reader = token_files.Reader(stream)
    for _ in range(200):
        first = int(rng.integers(0, len(ids)))
        n = int(rng.integers(0, len(ids) - first + 1))
        assert (reader.ids(first, n) == ids[first : first + n]).all()
    for first, n in ((9_999, 2), (-1, 1)):
        with pytest.raises(ValueError):
            reader.ids(first, n)
    with pytest.raises(ValueError, match="fit"):
        token_files.Writer(Kept(), 8).add(ids)
    raw = bytearray(stream.getvalue())
    raw[24 + 70 * 17 // 8] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.Reader(Kept(bytes(raw))).ids(70, 1)
    with pytest.raises(ValueError, match="no file"):
        token_files.Reader(Kept(bytes(raw[:-1])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abstmdrevl' \t\n12é²½ªß.!<|_\x0b\x01", "日", "\x85", "\x1c", "\0", "'ll", "don't", "internationalisation", "y" * 70]), max_size=20).map("".join), min_size=1, max_size=6))
def test_pieces_of_any_texts(texts):
    own, tokenizer = token_files.encoder(PATH), Tokenizer.from_file(PATH)
    raw = [t.encode() for t in texts]
    ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_spans_that_share_a_key_stay_apart(monkeypatch):
    monkeypatch.setattr(pieces, "span_keys", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words = ["abcdefghi", "abcdefghj", "abcdefghi", "b" * 70, "c" * 70, "b" * 70, "abcdefghij", "ab", "ab"]
    raw = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    codes, spans = pieces.distinct(np.frombuffer(raw, np.uint8), starts, ends)
    assert [words[spans[c]] for c in codes] == words
    assert pa.array(codes).null_count == 0
