"""Language ID, quality rules, quality classifier, license scan and chat perspectives."""

import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import chat_format, language_id, license_scan, quality_classifier, quality_rules
from lodestone.llm import queries as Q
from lodestone.llm.hashed_lr import character_families, characters
from lodestone.llm.shared import labelled_sample, mix, span_hashes, text_chunks, words_of
from tests.oracle import both

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "x" * 300_000, "word " * 50_000, "été été\nété été\n", "#*$ |<>&% #", "a\x00b \x0b c", "日本語 テキスト 😀", "same line here\nsame line here\n \nsame line here", "one"]


def held(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Language ID


def test_language_of_texts_apart(spark):
    rows = Q.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    apart = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in apart]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    net = language_id.train([("das ist ein haus und der garten " * 9, "de"), ("this is the house and the garden " * 9, "en")])
    docs = held(spark, [(i, t, "old") for i, t in enumerate(ODD)], "doc_id long, text string, score string")
    rows = {r["doc_id"]: r for r in language_id.identify(docs, net).collect()}
    assert len(rows) == len(ODD) and dict(docs.dtypes)["score"] == "string"
    for i, t in enumerate(ODD):
        lettered = bool(t) and any(c.isalpha() for c in t)
        assert (rows[i]["lang_pred"] in ("de", "en")) == lettered and (rows[i]["score"] > 0) == lettered
    assert language_id.identify(docs.limit(0), net).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.fit(docs.limit(0).withColumn("lang", F.lit("x"))) is None


def test_rounded_weights_agree_with_training_form():
    net = language_id.train([("das ist ein haus und der garten " * 9, "de"), ("this is the house and the garden " * 9, "en")])
    windows = language_id.as_windows("the garden and das haus " * 40)
    assert np.abs(net.peak(windows) - net.pooled(windows)[0]).max() < 0.02


def letter_junk(rng, texts):
    """Texts with letters and in no learned language; the last two are words of languages that training has never seen."""
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    found = []
    for _ in range(20):
        found.append(" ".join(word("abcdefghijklmnopqrstuvwxyz", int(rng.integers(2, 10))) for _ in range(60)))
        found.append("".join(rng.permutation(list(texts[int(rng.integers(len(texts)))][:600].lower()))))
        found.append("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 200)))
        found.append("x" * 300)
        found.append(" ".join(rng.permutation("nie jest się że do to jak ale co mnie był tylko już może gdy przez będzie wszystko nigdy człowiek dlaczego".split())))
        found.append(" ".join(rng.permutation("не на быть он что это она этот они мы весь который из то за свой год от так".split())))
    return found


def test_language_stage_rejects_letter_junk_and_keeps_rows_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    apart = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and len((r["text"] or "").split()) >= 20]
    net = language_id.fit(docs.where("crc32(cast(doc_id AS string)) % 4 <> 2").select("doc_id", "text", "lang"))
    scores = np.array(language_id.predict(net, [r["text"] for r in apart])[1])
    assert len(apart) > 200 and (scores >= corpus_pipeline.MIN_LANGUAGE).mean() > 0.99
    junk = letter_junk(np.random.default_rng(5), [r["text"] for r in apart])
    # a few junk rows among the documents: the stage itself throws them out
    added = held(spark, [(1_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    left = [r["doc_id"] for r in corpus_pipeline.identified(spark, docs.unionByName(added), SF).select("doc_id").collect()]
    assert sum(k >= 1_000_000 for k in left) <= len(junk) // 50
    assert sum(k < 1_000_000 for k in left) > 980


# Words over buffers


def test_words_and_hashes_by_brute_force():
    texts = [t or "" for t in ODD]
    for data, offsets, first, end in text_chunks(pa.array(texts)):
        starts, ends, bounds = words_of(data, offsets)
        hashes = span_hashes(data, starts, ends)
        seen = {}
        for i in range(end - first):
            own = texts[first + i].encode().split()
            got = [bytes(data[a:b]) for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
            assert got == own
            for word, h in zip(own, hashes[bounds[i] : bounds[i + 1]], strict=True):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


# Quality rules


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in runs.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_counts_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(held(spark, [(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    rows = quality_rules.judge(docs, None).collect()
    assert len(rows) == 200 + len(ODD)
    for r in rows:
        want = rules(r["text"])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed) and r["quality"] is None


@cache
def word_number(word):
    """The library's hash of one word, taken by itself."""
    raw = np.frombuffer(word, np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def plain_quality(model, text):
    """The probability of good quality, feature by feature from the model's weights."""
    cell, words, chars = (1 << quality_rules.BITS) - 1, (text or "").encode().split(), [int.from_bytes(c.encode(), "little") for c in text or ""]

    def run(part):
        code = part[0]
        for c in part[1:]:
            code = (code * 0x9E3779B1 + c) % (1 << 32)
        code = (code ^ (code >> 15)) * 2246822519 % (1 << 32)
        code = (code ^ (code >> 13)) * 2654435761 % (1 << 32)
        return code >> (32 - quality_rules.BITS)

    def pair(a, b):
        return 0 if a == b else int(mix(np.array([(word_number(a) * 0xD6E8FEB86659FD93 + word_number(b)) % (1 << 64)], np.uint64))[0]) & cell

    families = [[word_number(w) & cell for w in words], [pair(a, b) for a, b in zip(words, words[1:])], *([run(chars[i : i + n]) for i in range(len(chars) - n + 1)] for n in (2, 4))]
    margin = model.bias + sum(sum(float(table[p]) for p in places) / max(1, len(places)) for table, places in zip(model.tables, families, strict=True))
    return 1 / (1 + math.exp(-min(35, max(-35, model.slope * margin + model.offset))))


def test_quality_probability_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = quality_rules.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = quality_rules.judge(docs.unionByName(held(spark, [(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")), model).collect()
    assert len(rows) == 200 + len(ODD) and len({r["kept"] for r in rows}) == 2
    for r in rows:
        want = plain_quality(model, r["text"])
        assert abs(r["quality"] - want) < 1e-5
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= quality_rules.MIN_QUALITY)


def judged_apart(spark):
    """Labelled rows of texts that pass the counted rules, judged by a model fitted to the other rows."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = quality_rules.fit(docs, labels.where(~apart))
    return quality_rules.judge(docs.where(apart), model, keep=["doc_id"]).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").where("NOT base_failed AND label IS NOT NULL").collect()


def test_quality_of_rows_apart_is_calibrated(spark):
    rows = judged_apart(spark)
    p, y = np.array([r["quality"] for r in rows]), np.array([float(r["label"]) for r in rows])
    assert len(rows) > 60 and set(y) == {0.0, 1.0}
    bins = np.minimum((p * 4).astype(int), 3)
    error = sum(abs(p[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in range(4) if (bins == b).any())
    assert error < 0.12 and abs(p.mean() - y.mean()) < 0.1
    share = y.mean()  # the counted rules alone give every row of these the same share
    assert np.mean((p - y) ** 2) < 0.6 * share * (1 - share)
    kept = np.array([r["kept"] for r in rows])
    assert kept[y == 1].mean() > 0.95 and kept[y == 0].mean() < 0.7
    assert quality_rules.judge(held(spark, [], "text string"), None).count() == 0


@pytest.mark.parametrize("texts", [[None, None], ["", ""], [None, ""], ["", "a b", None]])
def test_partitions_without_text(spark, texts):
    docs = held(spark, list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    good = [("good plain words here", 1), ("bad*** junk### bad***", 0)] * 5
    for model in (None, quality_rules.train(good, 0.5)):
        assert quality_rules.judge(docs, model).count() == len(texts)
    assert {r["n_words"] for r in quality_rules.judge(docs, None).collect()} <= {0, 2}
    assert quality_classifier.classify(docs, quality_classifier.train(good)).count() == len(texts)
    net = language_id.train([("das ist ein haus und der garten " * 9, "de"), ("this is the house and the garden " * 9, "en")])
    assert language_id.identify(docs, net).count() == license_scan.scan(docs).count() == len(texts)
    turns = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("a").alias("role"), "text")
    assert chat_format.perspectives(turns).count() == len(texts)


def test_character_runs_by_brute_force():
    texts = [t or "" for t in ODD[:2] + ODD[6:]] + ["aé日😀aé日😀"]
    for data, offsets, first, end in text_chunks(pa.array(texts)):
        chars, bounds = characters(data, offsets)
        assert [int(n) for n in np.diff(bounds)] == [len(t) for t in texts[first:end]]
        assert len(set(zip(chars.tolist(), "".join(texts[first:end])))) == len(set("".join(texts[first:end])))
        seen = {}
        for family, size in zip(character_families(data, offsets, 18), (2, 4), strict=True):
            for i in range(end - first):
                own, t = family.places[family.bounds[i] : family.bounds[i + 1]], texts[first + i]
                assert len(own) == max(0, len(t) - size + 1)
                for k, place in enumerate(own.tolist()):
                    assert seen.setdefault((size, t[k : k + size]), place) == place


def test_sample_is_that_of_a_full_ranking(spark):
    rows = [(i, "abc"[i % 3] if i % 50 else "rare", f"text {i}") for i in range(6000)]
    docs = held(spark, rows, "doc_id long, lang string, text string").unionByName(held(spark, [(None, "a", "no key"), (7, None, "no label"), (9000, "b", None)] + [(8, "c", "text 8")] * 500, "doc_id long, lang string, text string"))
    ranked = {}
    for k, h, y in docs.where("doc_id < 6000 AND lang IS NOT NULL").select("doc_id", F.xxhash64("doc_id"), "lang").distinct().collect():
        ranked.setdefault(y, []).append((h, k))
    want = sorted((n, h, k, y) for y, own in ranked.items() for n, (h, k) in enumerate(sorted(own)[:90]))[:90]
    assert sorted(labelled_sample(docs, docs, "lang", "text", "doc_id", 90)) == sorted((f"text {k}", y) for _, _, k, y in want)
    few = docs.where("doc_id % 7 = 0")  # labels that mostly have no document
    got = labelled_sample(docs, few, "lang", "text", "doc_id", 400)
    assert len(got) == 400 and sum(y == "rare" for _, y in got) == sum(k % 7 == 0 for _, k in ranked["rare"])
    assert labelled_sample(docs.limit(0), docs, "lang", "text", "doc_id", 10) == []


def test_language_scores_by_brute_force():
    net = language_id.train([("das ist ein haus und der garten " * 9, "de"), ("this is the house and the garden " * 9, "en")])
    texts = ["The garden and the house. " * 30, "Ein Haus", "é" * 300, "7 x"]
    names, scores = language_id.predict(net, texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        raw = text.lower().encode()
        total = np.zeros(len(net.labels) + 1)
        for at in range(0, len(raw), language_id.WINDOW):
            window = raw[at : at + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")
            hidden = []
            for table, width in zip(net.tables, language_id.WIDTHS, strict=True):
                for f in range(language_id.FILTERS):
                    hidden.append(max(sum(float(table[j][window[i + j]][f]) for j in range(width)) for i in range(language_id.WINDOW - width + 1)))
            z = np.maximum(np.array(hidden) + net.shift, 0) @ net.out + net.bias
            p = np.exp(z - z.max())
            total += p / p.sum() * len(raw[at : at + language_id.WINDOW].replace(b"\0", b""))
        share = total / total.sum()
        assert name == net.labels[int(share[:-1].argmax())] and abs(score - share[:-1].max()) < 0.01


# Quality classifier


def auc(scored):
    good, bad = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


def test_quality_scores_of_labels_apart(spark):
    rows = Q.op8_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    apart = [(r["score"], r["quality"]) for r in rows if r["held_out"]]
    assert len(apart) > 50 and auc(apart) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_scores_by_brute_force():
    texts = ["good plain words here", "", "bad*** bad*** junk###", "über good plain über words", "x"]
    model = quality_classifier.train([("good plain words here", 1), ("bad*** junk### bad***", 0)] * 5)
    cell = (1 << quality_classifier.BITS) - 1
    for data, offsets, first, end in text_chunks(pa.array(texts)):
        got = quality_classifier.sigmoid(quality_classifier.margins(quality_classifier.word_families(data, offsets, quality_classifier.BITS), model.tables, model.bias))
    def number(word):  # the same hash of one word, taken by itself
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])

    def pair(a, b):
        return 0 if a == b else int(mix(np.array([(number(a) * 0xD6E8FEB86659FD93 + number(b)) % (1 << 64)], np.uint64))[0]) & cell

    for text, score in zip(texts, got, strict=True):
        words = text.split()
        margin = model.bias
        for table, places in zip(model.tables, ([number(w) & cell for w in words], [pair(a, b) for a, b in zip(words, words[1:])]), strict=True):
            margin += sum(float(table[p]) for p in places) / max(1, len(places))
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-6


def test_quality_scores_of_odd_texts(spark):
    model = quality_classifier.train([("good plain words here", 1), ("bad*** junk### bad***", 0)] * 5)
    docs = held(spark, [(i, t, 7) for i, t in enumerate(ODD)], "doc_id long, text string, SCORE int")
    rows = quality_classifier.classify(docs, model).collect()
    assert len(rows) == len(ODD) and rows[0]["score"] == rows[1]["score"]
    assert quality_classifier.classify(docs.limit(0), model).count() == 0
    assert quality_classifier.train([("only one label", 1)]) is None
    assert {r["score"] for r in quality_classifier.classify(docs, None).collect()} == {0.5}


# License scan


def license_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return low, words, found


def license_templates(texts):
    """(label, distinct words rarest first, words needed, length of a block), from document counts."""
    counts = {}
    for t in texts:
        for w in set(license_base(t)[1]):
            counts[w] = counts.get(w, 0) + 1
    found = []
    for label, t in license_scan.TEMPLATES:
        own = license_base(t)[1]
        n = len(set(own))
        found.append((label, sorted(set(own), key=lambda w: (counts.get(w, 0), w)), -(-9 * n // 10), -(-3 * len(own) // 2)))
    return found


def license_by_brute_force(text, templates):
    """Every run of words is a block; no filter."""
    low, words, found = license_base(text)
    met = []  # (template's words, label, anchor, first, last, share)
    for label, ordered, needed, reach in templates:
        own = set(ordered)
        hits = [i for i, w in enumerate(words) if w in own]
        for start in hits:
            block = [i for i in hits if start <= i < start + reach]
            shared = {words[i] for i in block}
            if len(shared) >= needed:
                rarest = min(shared, key=ordered.index)
                end = max(min(i for i in block if words[i] == w) for w in shared)
                met += [(own, label, i, start, end, len(shared) / len(own)) for i in block if words[i] == rarest]
    best = {}  # of the blocks around an anchor the fullest, then the shortest, then the last to begin
    for own, label, at, start, end, share in met:
        best[label, frozenset(own), at] = max(best.get((label, frozenset(own), at), (0, 0, 0, 0)), (share, start - end, start, end))
    short = {k: v for k, v in best.items() if not any(k[:2] == o[:2] and w[2] <= v[3] and v[2] <= w[3] and w[1] > v[1] and w[0] >= v[0] for o, w in best.items())}
    labels, score = {label for _, label in found}, 0.0
    for (label, own, at), (share, *_) in short.items():
        if not any(own < other and s <= at <= e for (_, other, _), (_, _, s, e) in short.items()):
            labels.add(label)
            score = max(score, share)
    at = [i for i, _ in found]
    return {"n_words": len(words), "n_base": len(found), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted({x for _, x in found})), "labels": ",".join(sorted(labels)), "score": 1.0 if found else score}


MIT = next(t for label, t in license_scan.TEMPLATES if label == "mit" and len(t) > 200)
MPL = "This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0."


def test_license_scan_by_brute_force(spark):
    planted = [
        "Intro.\nLicensed under CC BY-NC 4.0.\nEnd", "licensed  UNDER cc by 4.0", "MIT License mit license MIT-license", "mit\nlicense", "general public public license", "GNU General Public License; Apache license",
        f"head\n\n{MIT.replace(', ', ',' + chr(10))}\n\ntail", MIT[:200], "Lizenz: été MIT été license", "mitlicense", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Zlib License", "License MIT the under released", MPL, "// " + MPL.replace("\n", "\n// "), "Text licensed under CC BY 4.0, images licensed under CC BY-SA 4.0", "licensed one two three under four five cc six by 4.0",
        "\n".join(f"# {t}" for _, t in license_scan.TEMPLATES[4:12]),
    ]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(held(spark, [(10_000 + i, t) for i, t in enumerate(ODD + planted + planted[:1])], "doc_id long, text string"))
    rows = license_scan.scan(docs.withColumn("labels", F.lit(1))).collect()
    texts = dict(docs.collect())
    templates = license_templates(texts.values())
    assert len(rows) == docs.count()
    for r in rows:
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == license_by_brute_force(texts[r["doc_id"]], templates), texts[r["doc_id"]]
    by_id = {r["doc_id"]: r for r in rows}
    at = 10_000 + len(ODD)
    assert by_id[at + 13]["labels"] == by_id[at + 14]["labels"] == "mpl" and by_id[at + 15]["labels"] == "cc-by,cc-by-sa" and by_id[at]["labels"] == "cc-by-nc"
    assert license_scan.scan(docs.limit(0)).count() == 0
    places = license_scan.template_matches(docs.where(F.col("doc_id") == at + 15)).orderBy("anchor").collect()
    assert {("cc-by", 1, 6), ("cc-by-sa", 8, 14)} <= {(r["label"], r["first_word"], r["last_word"]) for r in places if r["containment"] == 1.0}
    assert license_scan.scan(docs.where(F.col("doc_id") == at + 15)).first()["labels"] == "cc-by,cc-by-sa"


def test_license_plan_has_one_scan_and_no_python(spark):
    plan = license_scan.scan(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_license_scan_keeps_repeated_keys(spark):
    rows = license_scan.scan(held(spark, [(None, "MIT License"), (None, "x"), (1, "MIT License"), (1, "MIT License"), (1, "y")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["labels"]) for r in rows) == [("1", ""), ("1", "mit"), ("1", "mit"), ("None", ""), ("None", "mit")]


# Chat


def test_chat_sql(spark):
    mine, theirs = both(spark, Q.op1_chat_perspectives, Q.ORACLES["op1_chat_perspectives"], SMALL)
    assert mine == theirs


def test_chat_perspectives(spark):
    rows = [("c", 1, "anna", "Hi"), ("c", 2, "ben", None), ("c", 0, "system", "Be kind"), ("c", 900, "carl", "Späť"), ("c", 900, "carl", "Späť"), ("d", None, None, "x"), ("e", 1, "system", "alone"), (None, 1, "zoe", "?")]
    turns = held(spark, rows, "conv_id string, turn long, role string, text string").withColumn("name", F.lit("clash"))
    got = chat_format.perspectives(turns).collect()
    assert sorted({(str(r["conv_id"]), r["perspective"]) for r in got}) == [("None", "zoe"), ("c", "anna"), ("c", "ben"), ("c", "carl"), ("d", "unknown")]
    for conv, who in {(r["conv_id"], r["perspective"]) for r in got}:
        own = sorted((r for r in got if (r["conv_id"], r["perspective"]) == (conv, who)), key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(len(r["rendered"]) for r in own)])[:-1])
        assert all(r["mask"] == (r["role"] == "assistant") and (r["name"] is None) == (r["role"] != "user") for r in own)
    carl = sorted((r for r in got if r["perspective"] == "carl"), key=lambda r: r["start"])
    assert [r["role"] for r in carl] == ["system", "user", "user", "assistant", "assistant"]
    assert carl[1]["rendered"] == "<|user anna|>\nHi<|end|>\n"
    assert chat_format.perspectives(turns.limit(0)).count() == 0


@pytest.mark.parametrize("turns", [2000])
def test_long_dialogue_is_placed_in_parts(spark, turns):
    df = spark.range(turns).selectExpr("1 AS conv_id", "id AS turn", "IF(id % 2 = 0, 'a', 'b') AS role", "repeat('x', int(id % 7)) AS text")
    rows = chat_format.perspectives(df).where("perspective = 'a'").orderBy("turn").collect()
    assert [r["start"] for r in rows] == list(np.cumsum([0, *(len(r["rendered"]) for r in rows)])[:-1])
