"""SimHash, fingerprints, BPE, packing, WARC and the pipeline."""

import gzip
import hashlib
import random
import types
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import byte_bpe, fingerprints, language_id, packing, quality_classifier, quality_rules, simhash, warc
from lodestone.llm import queries as Q
from tests.llm.test_texts import plain_quality, rules
from tests.oracle import both

SMALL = "/root/testdata/sf0.001"
RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [None, "", " \n ", "a", "One two", "one TWO three", "x" * 100_000, "wörd " * 30_000, "日本語 テキスト 😀", "same text here again", "same text here again", "a\x00b\x0bc d", "\x1c's\x1d'll \x1e\x1f x\x1f1 \x1c\x1c  don\x1dt", "It's 12³ ½ don't\t\r\n  x  "]


def documents(spark, more=ODD):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))


# SimHash


def plain_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Component of each key by brute force over all pairs."""
    parent = {k: k for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], dtype=np.uint64)
    for i, k in enumerate(keys):
        far = np.unpackbits((values[i + 1 :] ^ values[i]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) if i + 1 < len(keys) else []
        for j in np.flatnonzero(np.asarray(far) <= 3):
            a, b = sorted((find(k), find(keys[i + 1 + j])))
            parent[b] = a
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("block", [256, 4])
def test_simhash_components_by_brute_force(spark, block):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs, block=block).collect()
    prints = {k: plain_simhash(t) for k, t in docs.collect()}
    assert {r["doc_id"]: r["simhash"] % (1 << 64) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes(prints)


@pytest.mark.parametrize("block", [256, 8])
def test_links_in_crowded_cells(spark, block):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = set()
    for _ in range(150):  # a crowd around one fingerprint, with chains away from it
        fp = centre
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            fp ^= 1 << b
        prints.add(fp)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    simhash.checkpoint_dir(spark)
    found = simhash.links(nodes, block=block)
    assert all(bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") <= 3 for r in found.collect())
    roots = {r["node"]: r["root"] for r in simhash.components(spark, found).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for s in signed:
        groups[roots.get(s, s)].add(s)
    for k, root in classes({s: s % (1 << 64) for s in signed}).items():
        want[root].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("groups", [6, 7, 9])
def test_links_among_thousands_of_crowded_fingerprints(spark, groups):
    rng = random.Random(groups)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(2500):  # more than a cell's block, in chains and apart
        fp = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 2, 3, 5, 8, 8, 8])):
            fp ^= 1 << b
        prints.add(fp)
    prints |= {centre & ((1 << 34) - 1) | rng.getrandbits(30) << 34 for _ in range(700)}  # alike in half of the bits only
    signed = {int(np.array(p, np.uint64).view(np.int64)): p for p in prints}
    simhash.checkpoint_dir(spark)
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), groups=groups)
    roots = {r["node"]: r["root"] for r in simhash.components(spark, found).collect()}
    mine, want = defaultdict(set), defaultdict(set)
    for s in signed:
        mine[roots.get(s, s)].add(s)
    for k, root in classes(signed).items():
        want[root].add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values())) and len(want) > 100


def test_groups_grow_with_the_table():
    assert [simhash.groups_for(n) for n in (0, 10**6, 10**9, 10**10, 10**13)] == [6, 6, 8, 9, 9]


def test_members_of_cells_are_counted_without_a_window(spark):
    cells = spark.createDataFrame([(i, i % 2, i // 6) for i in range(25)], "fp long, grid int, key long")
    sized = simhash.with_members(cells)
    assert "Window" not in sized._jdf.queryExecution().executedPlan().toString()
    want = {i: sum(j % 2 == i % 2 and j // 6 == i // 6 for j in range(25)) for i in range(25)}
    assert {r["fp"]: r["members"] for r in sized.collect()} == {i: n for i, n in want.items() if n > 1}


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(5)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(200)]
    signed = [tuple(int(np.array(x, np.uint64).view(np.int64)) for x in p) for p in pairs]
    rows = spark.createDataFrame(signed, "a long, b long").select(F.bit_count(simhash.unary_counts("a").bitwiseXOR(simhash.unary_counts("b"))).alias("d")).collect()
    for (a, b), r in zip(pairs, rows, strict=True):
        counts = [[bin(x >> (2 * s) & 3).count("1") for s in range(32)] for x in (a, b)]
        assert r["d"] == sum(abs(x - y) for x, y in zip(*counts, strict=True)) <= bin(a ^ b).count("1")


def test_components_of_a_long_chain(spark):
    simhash.checkpoint_dir(spark)
    chain = spark.range(1, 60).selectExpr("id AS a", "id - 1 AS b").unionByName(spark.createDataFrame([(101, 100), (100, 100)], "a long, b long"))
    rows = {r["node"]: r["root"] for r in simhash.components(spark, chain).collect()}
    assert rows == {i: 0 for i in range(60)} | {100: 100, 101: 100}
    assert simhash.components(spark, chain.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, ["dup text number one here", "dup text number one here", None, ""]).withColumn("fp", F.lit("clash"))
    twice = docs.unionByName(docs.where("doc_id = 10000"))
    kept = simhash.keep_first(twice).collect()
    want = set(classes({k: plain_simhash(t) for k, t in docs.select("doc_id", "text").collect()}).values())
    assert sorted(r["doc_id"] for r in kept) == sorted(want) and set(kept[0].asDict()) == {"doc_id", "text", "fp"}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nulls = simhash.near_duplicates(spark.createDataFrame([(None, "lone text here now"), (None, "b"), (3, "b")], "doc_id long, text string")).collect()
    assert sorted(str(r["component_id"]) for r in nulls) == ["3", "3", "None"]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_repeated_and_null_keys(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "MOST_BROADCAST", broadcast)
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "other words stand here now"), (2, "other words stand here now"), (3, "third text of three"), (3, "THIRD text of three"), (None, "nobody's own text here"), (None, "nobody's own text here"), (None, "alpha beta gamma delta"), (None, "a fifth text without key"), (4, "x y z"), (5, "x y z")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_k", F.lit(0)).withColumn("root", F.lit(0))).collect()
    assert sorted((str(r["doc_id"]), r["text"].lower()) for r in kept) == [("1", "alpha beta gamma delta"), ("1", "other words stand here now"), ("3", "third text of three"), ("4", "x y z"), ("None", "a fifth text without key"), ("None", "nobody's own text here")]
    assert simhash.keep_first(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Fingerprints


def plain_sketch(text):
    words = [w for w in (text or "").lower().translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n = fingerprints.SHINGLE_WORDS
    runs = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    def chained(run):
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    hashes = {chained(r) for r in runs}
    return scaled(hashes)


def lowest(hashes, scale):
    return {h for h in hashes if h < -(1 << 63) + (1 << 64) // scale}


def scaled(hashes):
    scale = next((s for s in fingerprints.SCALES if len(lowest(hashes, s)) >= fingerprints.FEW), 1)
    return scale, lowest(hashes, scale)


def in_text(sketch):
    return f"{sketch[0]}:" + "".join(f"{h % (1 << 64):016x}" for h in sorted(sketch[1]))


def near_by_text(a, b):
    """The likeness that two fingerprints, as published, give."""
    (s, x), (t, y) = ((int(f.split(":")[0]), {int(f.split(":")[1][k : k + 16], 16) for k in range(0, len(f.split(":")[1]), 16)}) for f in (a, b))
    signed = lambda z: {h - (1 << 64) if h >> 63 else h for h in z}
    return likeness(lowest(signed(x), max(s, t)), lowest(signed(y), max(s, t)))


def plain_shingles(text):
    words = (text or "").lower().split()
    n = fingerprints.SHINGLE_WORDS
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / min(len(a), len(b)) if a and b else 0.0


def test_fingerprints_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)  # many ranges, so that neighbours meet across them
    docs = documents(spark)
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs.withColumn("sketch", F.lit(0))).collect()}
    texts = sorted((k, t or "") for k, t in docs.collect())
    assert len(rows) == len(texts)
    for (k, own), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        a, b, c, r = plain_sketch(own), plain_sketch(edited), plain_sketch(after), rows[k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == in_text(a) and r["edited_fingerprint"] == in_text(b)
        assert r["near_edited"] == near_by_text(in_text(a), in_text(b)) and r["near_next"] == near_by_text(in_text(a), in_text(c))
        for (scale, _), text, near in ((b, edited, r["near_edited"]), (c, after, r["near_next"])):
            want = likeness(plain_shingles(own), plain_shingles(text))
            if a[0] == scale == 1:
                assert near == want  # both hold all hashes
            elif a[0] == scale:
                assert abs(near - want) < 0.4
    by_pair = defaultdict(set)
    for r in rows.values():
        by_pair[r["fingerprint"], r["edited_fingerprint"]].add(r["near_edited"])
    assert all(len(v) == 1 for v in by_pair.values())


def test_fingerprints_of_few_rows(spark):
    one = fingerprints.compare_with_next(spark.createDataFrame([(5, "only one text")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["near_edited"] >= 0
    assert fingerprints.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = fingerprints.compare_with_next(spark.createDataFrame([(None, "n"), (1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")).collect()
    assert len(rows) == 4


def test_estimates_are_near_the_exact_containment(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    rows, truth = [], {}
    for i, size in enumerate([3, 6, 8, 8, 12, 20, 40, 70, 120, 300, 900] * 12):  # a text, then one that holds part of it
        at = rng.randrange(0, 4000 - size)
        own, held = words[at : at + size], rng.choice([0.0, 0.5, 1.0])
        cut = round(size * held)
        other = words[at : at + cut] + [f"x{i}_{k}" for k in range(rng.choice([10, 1500]))]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
        truth[2 * i] = likeness(plain_shingles(" ".join(own)), plain_shingles(" ".join(other)))
    found = {r["doc_id"]: r["near_next"] for r in fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    off = {size: [] for size in ("alike", "short", "long")}
    for k, want in truth.items():
        a, b = (len(rows[j][1].split()) for j in (k, k + 1))
        off["alike" if a <= 12 and b <= 18 else "short" if a <= 40 else "long"].append(found[k] - want)
    assert np.abs(off["alike"]).max() < 1e-9  # both sketches hold all hashes
    # a short text beside a long one is known by the quarter of its few hashes that the long one's scale leaves
    assert abs(np.mean(off["short"])) < 0.2 and np.sqrt(np.mean(np.square(off["short"]))) < 0.45
    assert abs(np.mean(off["long"])) < 0.03 and np.sqrt(np.mean(np.square(off["long"]))) < 0.15


def test_sketches_merge(spark):
    texts = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 400), ("b", 3), ("c", 40), ("d", 50), ("e", 0))]
    one = fingerprints.sketched(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    pairs = one.alias("x").join(one.alias("y"), F.col("x.k") < F.col("y.k")).select(F.col("x.k"), F.col("y.k").alias("j"), fingerprints.merged(F.col("x.sketch"), F.col("y.sketch")).alias("m"), fingerprints.containment(F.col("x.sketch"), F.col("y.sketch")).alias("c")).collect()
    shared = {(r["k"], r["j"]): r["c"] for r in pairs}
    for r in pairs:
        assert (r["m"]["scale"], set(r["m"]["hashes"])) == scaled(plain_hashes(texts[r["k"]]) | plain_hashes(texts[r["j"]]))
    assert shared[0, 1] == 0.0 and shared[1, 4] == 0.0


def plain_hashes(text):
    found = set()
    for run in plain_shingles(text):
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        found.add(h - (1 << 64) if h >= 1 << 63 else h)
    return found


# BPE


def test_bpe_is_that_of_tiktoken(spark):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    docs = documents(spark)
    texts = dict(docs.collect())
    rows = byte_bpe.encode(docs.withColumn("ids", F.lit(1)), RANKS, P.PATTERN).collect()
    for r in rows:
        assert r["ids"] == reference.encode_ordinary(texts[r["doc_id"]] or "")
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, block=3).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == {k: t or "" for k, t in texts.items()}
    both_ways = {r["doc_id"]: (r["ids"], r["decoded"]) for r in byte_bpe.round_trip(docs.withColumn("decoded", F.lit(1)), RANKS, P.PATTERN).collect()}
    assert both_ways == {r["doc_id"]: (r["ids"], texts[r["doc_id"]] or "") for r in rows}
    assert byte_bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_of_random_bytes_and_small_bounds(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 50)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 20)
    monkeypatch.setattr(byte_bpe, "MAX_PAIRS", 20)
    ranks = byte_bpe.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = byte_bpe.Transducer(ranks)
    rng = random.Random(1)
    for _ in range(1500):
        piece = "".join(rng.choice("aabcdeeehhiinnorsttéüß") for _ in range(rng.randrange(1, 40))).encode()
        assert machine.ids(piece) == reference._encode_single_piece(piece)


def test_bpe_query_digests(spark):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in Q.op7_byte_bpe(spark, SMALL).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


# Packing


def check_pieces(rows, texts, window=2048):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    for doc, own in ids.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at and length > 0
            at += length
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return [sum(n for _, n in p) for p in by_sequence.values()]


def test_packing_places_every_id_once(spark):
    docs = documents(spark).coalesce(2)
    pieces = packing.pack(docs.withColumn("start", F.lit("clash")), WORDS).withColumn("ids_crc32", F.crc32("ids"))
    sums = check_pieces(pieces.collect(), dict(docs.collect()))
    assert sum(n < 2048 for n in sums) <= 2  # the last of each partition
    assert packing.pack(docs.limit(0), WORDS).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string"), WORDS).collect()
    assert sorted(r["length"] for r in twice) == [1, 3, 3]


def test_blocks_carry_the_rest_on(spark, monkeypatch):
    lengths = [random.Random(7).randrange(1, 6000) for _ in range(400)]
    windows, rest = packing.plan(lengths)
    assert all(sum(p[2] for p in w) == 2048 for w in windows) and sum(p[2] for p in rest) < 2048
    seen = defaultdict(int)
    for w in [*windows, rest]:
        for doc, _, n in w:
            seen[doc] += n
    assert dict(seen) == dict(enumerate(lengths))
    assert packing.plan([]) == ([], [])


def test_combinations_and_least_squares():
    ways = packing.combinations_filling(8, 3)
    assert len(ways) == len(set(ways)) == sum(1 for a in range(1, 9) for b in range(0, a + 1) for c in range(0, b + 1) if a + b + c == 8)
    rng = np.random.default_rng(0)
    a = rng.random((12, 30))
    b = a @ np.maximum(rng.normal(size=30), 0)
    x = packing.non_negative_least_squares(a, b)
    assert x.min() >= 0 and np.linalg.norm(a @ x - b) < 1e-6 * np.linalg.norm(b)
    slope = a.T @ (rng.random(12) - a @ (y := packing.non_negative_least_squares(a, target := rng.random(12))))
    slope = a.T @ (target - a @ y)
    assert slope.max() < 1e-6 and np.abs(slope[y > 0]).max() < 1e-6


def test_word_ids_are_those_of_the_tokenizer():
    ids, tokenizer = packing.tokenize(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(2)
    signs = "abéÉİΣß ’ 123²½٣_-'s'll\t\r\x1c\x85\xa0日😀<|endoftext|>"
    for _ in range(800):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30))) + rng.choice(["", "<|endoftext|>", " don't", "İI"])
        assert ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_asked_for_once_and_long_runs_are_not_kept():
    class Model:
        calls = 0

        def tokenize(self, word):
            self.calls += 1
            return [types.SimpleNamespace(id=len(word))]

    model = Model()
    words = packing.WordIds(model)
    for _ in range(2):
        for k in range(250_000):
            words["".join(chr(97 + int(d)) for d in str(k))]
    assert model.calls == 250_000
    assert np.frombuffer(words["ab,cd."], np.uint32).tolist() == [2, 1, 2, 1]
    assert np.frombuffer(words["x" * 5000 + "!"], np.uint32).tolist() == [5000, 1] and max(map(len, words)) < 100


# WARC


def test_warc_sql(spark):
    mine, theirs = both(spark, Q.op10_warc, Q.ORACLES["op10_warc"], SMALL)
    assert mine == theirs


def test_warc_records(spark, tmp_path):
    long = "ä" * 60
    rows = [(3, "http://x/ä b\r\nEvil: 1", long), (1, "http://x/1", long), (2, "http://x/2", "short"), (4, None, "short"), (5, "u", None), (6, "u", ""), (7, "u", "a\r\n\r\nb" * 40), (None, "n", "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write(pages, f"file://{tmp_path}/w")
    facts = {r["key"]: r for r in index.collect()}
    for r in facts.values():
        with open(r["archive"], "rb") as f:
            f.seek(r["offset"])
            fields, payload = warc.parse(gzip.decompress(f.read(r["length"])))
        assert fields["warc-type"] == r["record_type"] and "evil" not in fields
        assert payload == (b"" if r["record_type"] == "revisit" else dict((k, h or "") for k, _, h in rows)[r["key"]].encode())
    assert facts[3]["record_type"] == "revisit" and facts[3]["refers_to"] == 1 and facts[4]["record_type"] == "response"
    back = {r["key"]: r for r in warc.read(index).collect()}
    assert back[3]["payload"] is None and back[3]["payload_bytes"] == 120 and bytes(back[7]["payload"]).decode() == rows[6][2]
    assert warc.read(index.where("key IN (2, 7)")).count() == 2
    empty = warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and warc.read(empty).count() == 0


def test_ranges_are_read_together():
    gap = warc.MAX_GAP
    reads = list(warc.coalesced([(0, 10), (10, 5), (15 + gap, 5), (30 + 2 * gap, 1)]))
    assert [(a, b, len(i)) for a, b, i in reads] == [(0, 20 + gap, 3), (30 + 2 * gap, 31 + 2 * gap, 1)]
    big = list(warc.coalesced([(0, warc.MAX_READ), (warc.MAX_READ, 1)]))
    assert len(big) == 2


# Partitions of nothing but null or empty texts


@pytest.mark.parametrize("texts", [[None, None], ["", ""], [None, ""], ["", "a b", None]])
def test_partitions_without_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    n = len(texts)
    assert simhash.near_duplicates(docs).count() == fingerprints.compare_with_next(docs).count() == n
    assert byte_bpe.round_trip(docs, RANKS, P.PATTERN).count() == byte_bpe.encode(docs, RANKS, P.PATTERN).count() == packing.pack(docs, WORDS).count() == n
    assert byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    assert warc.read(warc.write(pages)).count() == n


# Pipeline


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    net = language_id.fit(docs.select("doc_id", "text", "lang"))
    names, scores = language_id.predict(net, [r["text"] for r in rows.values()])
    left = [k for k, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= corpus_pipeline.MIN_LANGUAGE]
    one = corpus_pipeline.identified(spark, docs, SMALL)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(left) and len(left) > 190
    two = corpus_pipeline.of_quality(spark, one, SMALL)
    model = quality_rules.fit(one.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    def fails(r):
        return r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]

    want = sorted(k for k in left if not fails(rules(rows[k]["text"])) and plain_quality(model, rows[k]["text"]) >= 0.3)
    assert sorted(r["doc_id"] for r in two.collect()) == want and 0 < len(want) < len(left)
    three = corpus_pipeline.without_near_duplicates(spark, two, SMALL)
    stay = set(classes({k: plain_simhash(rows[k]["text"]) for k in want}).values())
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(stay)
    got = corpus_pipeline.run(spark, SMALL).collect()
    check_pieces(got, {k: rows[k]["text"] for k in stay})


def test_pipeline_of_odd_documents(spark):
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() >= 0
        assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_no_internal_name_clashes(spark):
    names = ["_text", "_text_", "_ids", "k0", "v0", "row", "words", "hashes", "_own", "_next", "_key", "_range", "_ghost", "_edited_text"]
    docs = spark.createDataFrame([(1, "one two three", [5], *names)], "doc_id long, text string, ids array<int>, " + ", ".join(f"`{n}` string" for n in names))
    found = [simhash.fingerprints(docs), byte_bpe.round_trip(docs, RANKS, P.PATTERN), byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS), fingerprints.sketched(docs)]
    found += [language_id.identify(docs, None), quality_rules.judge(docs, None), quality_classifier.classify(docs, None)]
    for rows in found:
        assert [rows.first()[n] for n in names] == names
    assert fingerprints.compare_with_next(docs).first()["near_next"] == 1.0


def test_a_window_that_is_too_small():
    with pytest.raises(ValueError):
        packing.plan([5], 31)
