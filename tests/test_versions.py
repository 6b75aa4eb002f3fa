"""Versioned tables, the delta catalog and the type index that follows it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import structure
from lodestone.sources import corpus, versions

ROW = "path string, text string"


def texts(spark, held):
    return spark.createDataFrame(list(held.items()), ROW).withColumn("stamp", F.sha2("text", 256))


def test_changes_of_two_tables(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", None)], "path string, stamp string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1"), ("e", None)], "path string, stamp string")
    assert {(r["path"], r["stamp"], r["change"]) for r in versions.changes(before, now).collect()} == {("b", "2", "changed"), ("d", "1", "changed"), ("e", None, "added")}
    assert {(r["path"], r["change"]) for r in versions.changes(now, before.where("path = 'a'")).collect()} == {(p, "removed") for p in "bcde"}


def test_a_table_follows_random_edits(spark, tmp_path, monkeypatch):
    """After any edits the rows are those of a table built anew; merged parts change nothing; no folder stays unnamed."""
    monkeypatch.setattr(versions, "MOST_PARTS", 2)
    table, draw, held = versions.Versioned(spark, str(tmp_path / "t"), "path string, word string"), random.Random(5), {f"p{k}": "x y" for k in range(12)}
    words = lambda rows: rows.select("path", F.explode(F.split("text", " ")).alias("word"))  # noqa: E731  two rows a path, or one
    assert table.read().count() == 0
    for turn in range(7):
        rows = texts(spark, held)
        done = table.follow(rows, words)
        if turn == 0:
            assert done == {"added": 12, "changed": 0, "removed": 0}
        assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, words(rows).collect()))
        assert table.follow(rows, words) == {"added": 0, "changed": 0, "removed": 0}
        for p in draw.sample(sorted(held), 2):
            held[p] = f"{turn} {p}" if draw.random() < 0.7 else f"z{turn}"
        del held[draw.choice(sorted(held))]
        held[f"q{turn}"] = "new"
    manifests = [f for f in os.listdir(tmp_path / "t") if f.startswith("manifest")]
    named = {p["name"] for m in manifests for p in table.manifest(m)["parts"]}
    assert len(manifests) == versions.KEPT and {f for f in os.listdir(tmp_path / "t") if f.startswith("part-")} == named
    assert len(table.manifest()["parts"]) <= 1 + versions.MOST_PARTS


def test_a_reader_keeps_its_version(spark, tmp_path):
    table = versions.Versioned(spark, str(tmp_path / "t"), ROW)
    take = lambda rows: rows.select("path", "text")
    table.follow(texts(spark, {k: k for k in "abcdef"}), take)
    early = table.read()
    table.follow(texts(spark, {k: k for k in "bcdef"}), take)
    assert early.count() == 6 and table.read().count() == 5
    # a job that fails leaves the version as it was
    with pytest.raises(Exception, match="lost"):
        table.follow(texts(spark, {"a": "1"}), lambda rows: rows.select("path", F.raise_error(F.lit("lost")).cast("string").alias("text")))
    assert table.read().count() == 5


def test_only_changed_files_are_opened(spark, tmp_path):
    root = tmp_path / "w"
    (root / "sub").mkdir(parents=True)
    for name, text in (("a.py", "x"), ("sub/b.py", "y"), ("c.txt", "z" * 30), ("big.txt", "w" * 9000), ("big.py", "v" * 9000)):
        (root / name).write_text(text)
    catalog = corpus.Catalog(spark, str(root), str(tmp_path / "t"), size_cap=1000)
    read = lambda c: {r["path"]: r["content"] and bytes(r["content"]).decode() for r in c.files().collect()}
    first = read(catalog)
    assert first["big.txt"] is None and len(first["big.py"]) == 9000  # structure takes oversized sources, nothing takes the other
    assert {r["path"] for r in catalog.files().where("oversized AND NOT is_binary").collect()} == {"big.txt", "big.py"}
    was = os.stat(root / "sub/b.py")
    (root / "sub/b.py").write_text("!")  # same size, and the same time: whoever opened it again would see it
    os.utime(root / "sub/b.py", ns=(was.st_atime_ns, was.st_mtime_ns))
    (root / "a.py").write_text("xx")
    (root / "c.txt").unlink()
    (root / "new.md").write_text("n")
    assert catalog.refresh() == {"added": 1, "changed": 1, "removed": 1}
    assert read(catalog) == {k: v for k, v in (first | {"a.py": "xx", "new.md": "n"}).items() if k != "c.txt"}
    later = corpus.Catalog(spark, str(root), str(tmp_path / "t"), size_cap=1000)  # another session finds the table
    assert later.refresh() == {"added": 0, "changed": 0, "removed": 0} and read(later)["sub/b.py"] == "y"
    assert corpus.Catalog(spark, str(root), str(tmp_path / "t"), size_cap=10_000).refresh()["added"] == 5  # other flags: built anew


def test_the_type_index_follows_edits(spark, tmp_path):
    draw, table = random.Random(2), versions.Versioned(spark, str(tmp_path / "t"), structure.SYMBOL)
    held = {f"m{k}.py": f"class A{k % 3}:\n    pass\n" for k in range(6)} | {"n.txt": "class No:\n"}
    for _ in range(4):
        files = spark.createDataFrame(list(held.items()), "path string, content string")
        structure.keep(files.withColumn("stamp", F.sha2("content", 256)), table)
        anew = structure.symbols(files)
        for derived in (structure.type_index, structure.references, structure.codemaps):
            assert sorted(map(tuple, derived(table.read()).collect())) == sorted(map(tuple, derived(anew).collect()))
        for p in draw.sample(sorted(held), 2):
            held[p] = draw.choice(["", "class B:\n    def f(self) -> A1:\n        pass\n", "class A2(B):\n    pass\n"])
        held.pop(draw.choice(sorted(held)))
