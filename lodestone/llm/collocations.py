"""Phrase collocations by prefix growth: frequent prefixes are extended to the right, depth first, over projected pointers.

A word is its 64-bit key; keys are held against the whole vocabulary and drawn anew should two words share one, so
counts of keys are counts of words. Three passes over the texts count words, then pairs of frequent words (by one
number each, which two pairs may share), and project each occurrence of a frequent pair to it and the frequent chain
of words that follows; equal ones are summed in the task and again before they are dealt. Each frequent prefix is
then one task's: it sorts its pointers by the next word, keeps the words that are frequent after the prefix, and goes
on with their pointers. A prefix with very many pointers is dealt to several tasks, whose counts are added up. Which words and pairs are frequent is told to the passes by a bitmap of
bounded size: what it lets through by mistake is only counted in vain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.fill_in_middle import gathered
from lodestone.llm.shared import carried, mix, span_keys, text_chunks, work_folder

MAX_WORDS = 5
UNKNOWN = "und"
#: Bits of a bitmap for each thing that it holds, and its most bits (128 MB) whatever it holds.
BITS_EACH, MOST_BITS = 16, 1 << 30
#: Bytes of text that are counted at once, and different keys that a task gathers before it hands them on.
CHUNK, MOST_KEYS = 2 << 20, 400_000
#: Pointers of a prefix that one task gets at most; fewer where the table is small, so that tasks are alike.
MOST_POINTERS, LEAST_POINTERS = 200_000, 500
#: Parts in which a language's best phrases are found before they meet.
PARTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: 0: part of a word, 1: space, 2: the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Words:
    """The words of some rows: lower-cased bytes, spans, keys, place of their row, and whether the next one follows in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seed: int):
        self.data = _LOWER[data]
        kind = _KIND[self.data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == 0
        edge = inside[1:] != inside[:-1]
        begins, ends = edge & inside[1:], edge & inside[:-1]
        heads = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        split = heads[inside[heads] & inside[heads + 1]]  # words never go on in the next row
        begins[split] = ends[split] = True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends)
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        self.keys = span_keys(self.data, self.starts, self.ends, seed).view(np.int64)
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == 2, out=breaks[1:])
        self.joined = np.zeros(len(self.starts), bool)
        if len(self.starts):
            self.joined[:-1] = (breaks[self.starts[1:]] == breaks[self.ends[:-1]]) & (self.rows[1:] == self.rows[:-1])

    def texts(self, at: np.ndarray) -> pa.Array:
        n = self.ends[at] - self.starts[at]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(gathered(self.data, self.starts[at], n)))


def grouped(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each different row of the columns, and the sum of n over its like.

    Rows are told apart by a hash; where different rows share one, some are left as they are, for later sums to join.
    """
    key = reduce(lambda h, c: mix(h + c.view(np.uint64)), columns[1:], mix(columns[0].view(np.uint64)))
    codes, found = pd.factorize(key)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    like = first[codes]
    apart = np.flatnonzero(~np.logical_and.reduce([c == c[like] for c in columns]))
    codes[apart] = len(found) + np.arange(len(apart))
    return np.concatenate([first, apart]), np.bincount(codes, weights=n, minlength=len(found) + len(apart)).astype(np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two keys in this order; others may share it."""
    b = b.view(np.uint64)
    return a ^ ((b << np.uint64(21)) | (b >> np.uint64(43))).view(np.int64)


class Bitmap:
    """Which keys may be in a set: the bit at their lowest bits. Has a bit for every key of the set, and never more than MOST_BITS."""

    def __init__(self, rows: DataFrame, key: Column):
        held = rows.count()
        self.bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_EACH * held).bit_length()))
        slot = key.bitwiseAND(F.lit(self.bits - 1)) + 1
        found = rows.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("b"))
        raw = bytearray(self.bits // 8)
        for k, b in found.collect():  # 4 KB each, self.bits in all
            raw[(k - 1) * 4096 : k * 4096] = b
        self.shared = rows.sparkSession.sparkContext.broadcast(bytes(raw))

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & np.int64(self.bits - 1)
        return (np.frombuffer(self.shared.value, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def tallied(docs: DataFrame, seed: int, columns: list[str], chosen: Callable[[Words], tuple[np.ndarray, list[np.ndarray]]], words: bool = False, by_lang: bool = True) -> DataFrame:
    """lang, the columns, n (and, of words, the word): how often chosen() gives each row of columns for a language's words
    (lang null: for all languages' together).

    Tasks sum up what they meet; a key may come from several tasks, and several times from one.
    """
    names = ["lang", *columns, "n", *(["word"] if words else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        parts: list[tuple[list[np.ndarray], np.ndarray, pa.Array | None]] = []
        held = 0

        def together() -> tuple[list[np.ndarray], np.ndarray, pa.Array | None]:
            all_columns = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
            rows, n = grouped(all_columns, np.concatenate([p[1] for p in parts]))
            return [c[rows] for c in all_columns], n, pa.concat_arrays([p[2] for p in parts]).take(pa.array(rows)) if words else None

        def handed(made: list[np.ndarray], n: np.ndarray, texts: pa.Array | None) -> pa.RecordBatch:
            named = pa.array(list(langs), pa.string()).take(pa.array(made[0], mask=made[0] < 0))
            return pa.RecordBatch.from_arrays([named, *map(pa.array, made[1:]), pa.array(n), *([texts] if words else [])], names=names)

        for batch in batches:
            for data, offsets, first, end in text_chunks(batch.column(1), CHUNK):
                of = batch.column(0).slice(first, end - first).dictionary_encode()
                own = np.array([langs.setdefault(x, len(langs)) for x in of.dictionary.to_pylist()], np.int64)[of.indices.to_numpy()]
                met = Words(data, offsets, seed)
                at, made = chosen(met)
                made = [own[met.rows[at]] if by_lang else np.full(len(at), -1), *made]
                rows, n = grouped(made, np.ones(len(at)))
                parts.append(([c[rows] for c in made], n, met.texts(at[rows]) if words else None))
                held += len(rows)
                if held > MOST_KEYS:
                    parts = [together()]
                    held = len(parts[0][1])
                    if held > MOST_KEYS // 2:
                        yield handed(*parts[0])
                        parts, held = [], 0
        if parts:
            yield handed(*together())

    return docs.mapInArrow(run, ", ".join(["lang string", *(f"{c} long" for c in columns), "n long", *(["word string"] if words else [])]))


def grown(dealt: DataFrame, least: int) -> DataFrame:
    """lang, k, h1 .. h5 and n of the phrases of three words and more that are frequent (of dealt prefixes: of all).

    dealt: projected pointers, those of a prefix (and shard) one after the other.
    """
    keys = ["h1", "h2", "h3", "h4", "h5"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def phrases(block: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            h = [block.column(2 + i).to_numpy() for i in range(5)]
            k, n, shards = (block.column(c).to_numpy() for c in (1, 7, 9))
            found: list[tuple[int, int, int]] = []  # (a pointer, words, occurrences)

            def extend(pointers: np.ndarray, depth: int, enough: int) -> None:
                """The phrases that begin with the first `depth` words of these pointers."""
                further = pointers[k[pointers] > depth]
                if depth == MAX_WORDS or not len(further):
                    return
                further = further[np.argsort(h[depth][further], kind="stable")]
                word = h[depth][further]
                cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                sums = np.add.reduceat(n[further], cuts)
                ends = np.append(cuts[1:], len(further))
                for i in np.flatnonzero(sums >= enough).tolist():
                    own = further[cuts[i] : ends[i]]
                    found.append((int(own[0]), depth + 1, int(sums[i])))
                    extend(own, depth + 1, enough)

            sums = np.add.reduceat(n, bounds[:-1])
            enough = np.where(shards[bounds[:-1]] > 1, 1, least)
            for i in np.flatnonzero(sums >= enough).tolist():
                found.append((int(bounds[i]), 3, int(sums[i])))
                extend(np.arange(bounds[i], bounds[i + 1]), 3, int(enough[i]))
            if found:
                at, words, total = (np.array(c, np.int64) for c in zip(*found, strict=True))
                made = [np.where(words > i, h[i][at], 0) for i in range(5)]
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(at)), pa.array(words), *map(pa.array, made), pa.array(total)], names=["lang", "k", *keys, "n"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            block = pa.concat_batches(waiting)
            prefix = [block.column(0).dictionary_encode().indices.to_numpy(), *(block.column(c).to_numpy() for c in (2, 3, 4, 8))]
            changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in prefix])) + 1
            if len(changes):  # the last prefix may go on
                yield from phrases(block.slice(0, changes[-1]), np.concatenate([[0], changes]))
                block = block.slice(changes[-1])
            waiting = [block]
        if waiting:
            yield from phrases(pa.concat_batches(waiting), np.array([0, sum(b.num_rows for b in waiting)]))

    return dealt.mapInArrow(run, "lang string, k long, h1 long, h2 long, h3 long, h4 long, h5 long, n long")


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): lang, h, word of all frequent words; lang, p, f of all frequent phrases of one to MAX_WORDS
    words, p being their words' keys; lang, n of all occurrences of words. All read from tables in the shared folder."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession, "collocations")
    rows, _ = carried(docs, [], [], [F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)), F.col(f"`{text}`")])
    every = lambda met: np.arange(len(met.starts))

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    for seed in range(1, 65):
        met = tallied(rows, seed, ["h"], lambda met: (every(met), [met.keys]), words=True)
        vocabulary = kept(met.groupBy("lang", "h", "word").agg(F.sum("n").alias("n")), f"vocabulary-{seed}")
        if vocabulary.groupBy("lang", "h").count().where("count > 1").isEmpty():  # no two words of a language share a key
            break
    else:
        raise ValueError("no seed gives every word a key of its own")
    words = vocabulary.where(F.col("n") >= least)
    known = Bitmap(words, F.col("h"))

    def pairs(met: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        usual = known.has(met.keys)
        at = np.flatnonzero(met.joined[:-1] & usual[:-1] & usual[1:])
        return at, [paired(met.keys[at], met.keys[at + 1])]

    # one number a pair, over all languages: those that reach the count hold all frequent pairs, and next to no others
    two = kept(tallied(rows, seed, ["pair"], pairs, by_lang=False).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "pairs")
    chains = Bitmap(two, F.col("pair"))

    def projected(met: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        goes = np.zeros(len(met.keys) + 4, bool)
        if len(met.keys):
            goes[: len(met.keys) - 1] = met.joined[:-1] & chains.has(paired(met.keys[:-1], met.keys[1:]))
        at = np.flatnonzero(goes)
        third = goes[at + 1]
        fourth = third & goes[at + 2]
        fifth = fourth & goes[at + 3]
        key = np.concatenate([met.keys, np.zeros(4, np.int64)])
        return at, [2 + third.astype(np.int64) + fourth + fifth, key[at], key[at + 1], np.where(third, key[at + 2], 0), np.where(fourth, key[at + 3], 0), np.where(fifth, key[at + 4], 0)]

    keys = ["h1", "h2", "h3", "h4", "h5"]
    pointers = kept(tallied(rows, seed, ["k", *keys], projected).groupBy("lang", "k", *keys).agg(F.sum("n").alias("n")), "pointers")
    most = min(MOST_POINTERS, max(LEAST_POINTERS, pointers.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    double = pointers.groupBy("lang", "h1", "h2").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select("lang", F.array("h1", "h2").alias("p"), "f")
    prefix = ["lang", "h1", "h2", "h3"]
    pointers = pointers.where("k > 2")
    large = pointers.groupBy(*prefix).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most).select(*prefix, F.ceil(F.col("held") / most).alias("shards"))
    spread = pointers.join(large, prefix, "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    spread = spread.select("lang", "k", *keys, "n", F.pmod(F.xxhash64("k", "h4", "h5"), F.col("shards")).alias("shard"), "shards")
    dealt = spread.repartition(*prefix, "shard").sortWithinPartitions(*prefix, "shard")
    longer = grown(dealt, least).groupBy("lang", "k", *keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    as_array = [words.select("lang", F.array("h").alias("p"), F.col("n").alias("f")), double]
    as_array.append(longer.select("lang", F.slice(F.array(*keys), F.lit(1), F.col("k").cast("int")).alias("p"), F.col("n").alias("f")))
    phrases = kept(reduce(DataFrame.unionByName, as_array), "phrases")
    return words.select("lang", "h", "word"), phrases, vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, covered_percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best `top` phrases of two to five words.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and those at spaces and tabs into words. A
    phrase that occurs `least` times or more is a candidate; each way to cut it in two gives 1000 a n / (l r), rounded
    down, of its own count a, its parts' l and r, and the language's words n, and the lowest counts. A candidate that lies
    in a longer one with covered_percent of its occurrences or more is left out. Equal scores are ordered by a, then by the
    phrase. A null text has no words, a null language is UNKNOWN; repeated rows count as often as they occur; a language
    without candidates has no rows, and so has an empty table.
    """
    words, phrases, totals = frequent(docs, text, lang, least)
    k = F.size("p")
    candidates = phrases.where(k > 1).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1)))
    cuts = cuts.withColumns({"left": F.slice("p", F.lit(1), F.col("cut")), "right": F.slice("p", F.col("cut") + 1, k - F.col("cut"))})
    halves = cuts.join(phrases.select("lang", F.col("p").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(phrases.select("lang", F.col("p").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")  # noqa: E731  products have up to 38 digits
    halves = halves.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")), "down": wide("l") * wide("r")}).withColumn("score", F.expr("up div down"))
    scored = halves.groupBy("lang", "p").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("best")).select("lang", "p", "best.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda m: F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.slice("p", i, m))))
    inside = candidates.where(k > 2).select("lang", F.explode(inner).alias("p"), F.col("a").alias("longer")).groupBy("lang", "p").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "p"], "left").where(F.coalesce(100 * F.col("longer"), F.lit(-1)) < covered_percent * F.col("a"))
    spelled = left.select("*", F.posexplode("p").alias("i", "h")).join(words, ["lang", "h"]).groupBy("lang", "p", "a", "l", "r", "n", "score")
    named = spelled.agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w")).select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
