"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations as C
from lodestone.llm import queries as Q
from tests.oracle import both


def plain(rows, least, covered_percent=100, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in candidates.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    longer[lang, p[i:j]] = max(longer[lang, p[i:j]], a)
    found = []
    for (lang, p), a in candidates.items():
        if (lang, p) in longer and 100 * longer[lang, p] >= covered_percent * a:
            continue
        n = totals[lang]
        score, _, l, r = min((1000 * a * n // (counts[lang, p[:c]] * counts[lang, p[c:]]), c, counts[lang, p[:c]], counts[lang, p[c:]]) for c in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), l, r, n))
    out, rank = [], Counter()
    for lang, score, a, p, l, r, n in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, n, -score))
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "b", "B", "the", "of", "Über", "über", "x" * 70, "internationalisation", "日本", "a-b", "\x1c", "'s"]
    rows = [(None, "en"), ("", None), (" \t ", "de"), ("A b.A b,a b\n", "und"), (" a b", None)]
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]) for _ in range(rng.randrange(0, 40)))
        rows += [(text, rng.choice(["en", "en", "de", None]))] * rng.choice([1, 1, 3])
    rows += [("the of a b Über the of a b", "en")] * 60  # a passage that most rows hold
    return rows


@pytest.mark.parametrize("seed, small", [(1, False), (2, True), (3, True)])
def test_all_phrases_by_brute_force(spark, monkeypatch, seed, small):
    if small:  # prefixes are dealt to several tasks, and tasks hand on what they count early
        for name, value in (("MOST_POINTERS", 3), ("LEAST_POINTERS", 3), ("CHUNK", 200), ("MOST_KEYS", 40)):
            monkeypatch.setattr(C, name, value)
    rows = made(seed)
    docs = spark.createDataFrame([(t, i, g, 1, "y") for i, (t, g) in enumerate(rows)], "text string, h long, lang string, n int, word string").repartition(6)
    for least, percent, top in ((4, 100, 2000), (9, 60, 7)):
        got = [tuple(r) for r in C.collocations(docs, least=least, covered_percent=percent, top=top).orderBy("lang", "rank").collect()]
        assert got == plain(rows, least, percent, top) and len(got) > 10


def test_large_counts_are_exact(spark, monkeypatch):
    big = 10**14
    words = spark.createDataFrame([("en", 1, "x"), ("en", 2, "y")], "lang string, h long, word string")
    phrases = spark.createDataFrame([("en", [1], big + 7), ("en", [2], big + 9), ("en", [1, 2], big - 1)], "lang string, p array<long>, f long")
    totals = spark.createDataFrame([("en", 10**17 + 3)], "lang string, n long")
    monkeypatch.setattr(C, "frequent", lambda *_: (words, phrases, totals))
    row = C.collocations(spark.createDataFrame([], "text string, lang string")).first()
    assert row["score"] == 1000 * (big - 1) * (10**17 + 3) // ((big + 7) * (big + 9))


def test_words_that_share_a_key_get_others(spark, monkeypatch):
    real, seeds = C.tallied, []

    def tallied(docs, seed, columns, chosen, words=False, **more):
        seeds.append((seed, words))
        found = real(docs, seed, columns, chosen, words, **more)
        return found.withColumn("h", F.col("h") % 2) if words and seed < 3 else found

    monkeypatch.setattr(C, "tallied", tallied)
    rows = made(4, 20)
    got = [tuple(r) for r in C.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5).orderBy("lang", "rank").collect()]
    assert got == plain(rows, 5) and seeds == [(1, True), (2, True), (3, True), (3, False), (3, False)]


def test_empty_tables_and_languages_without_words(spark):
    for rows in ([], [(None, None), ("", "en"), (".,", "de")]):
        assert C.collocations(spark.createDataFrame(rows, "text string, lang string"), least=1).count() == 0


def test_bitmap_holds_all_keys_and_little_else(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 9000)
    rows = spark.createDataFrame([(int(k),) for k in keys], "h long")
    held = C.Bitmap(rows, F.col("h"))
    assert held.has(keys).all() and held.has(keys + 12345).mean() < 0.1


def test_query_gives_what_sql_gives(spark):
    mine, theirs = both(spark, Q.op11_collocations, Q.ORACLES["op11_collocations"], "/root/testdata/sf0.01")
    assert mine == theirs and mine[1]
