import random
import subprocess
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import edits, intervals
from lodestone.sources import vcs

SCHEMA = "path string, edit_index int, search string, replace string, `all` boolean"


def plan(spark, content, *wanted):
    files = spark.createDataFrame([("f", content)], "path string, content string")
    rows = [("f", i, s, r, a) for i, (s, r, a) in enumerate(wanted)]
    return edits.planned(files, spark.createDataFrame(rows, SCHEMA)).first()


def test_literal_edits(spark):
    assert plan(spark, "a\nb\nc\n", ("b", "B", False))["after"] == "a\nB\nc\n"
    assert plan(spark, "x x x", ("x", "yy", True))["after"] == "yy yy yy"
    many = plan(spark, "x\nx\n", ("x", "y", False))
    assert many["status"] == "failed" and many["error"]["code"] == "multiple_matches" and many["error"]["lines"] == [1, 2]
    assert plan(spark, "a.b*c", (".b*", "-", False))["after"] == "a-c"
    assert plan(spark, "q\\Er", ("\\Er", "!", False))["after"] == "q!"


def test_batches_are_all_or_nothing(spark):
    both = plan(spark, "one two three", ("one", "1", False), ("three", "3", False))
    assert both["after"] == "1 two 3" and both["edits_applied"] == 2
    clash = plan(spark, "abcdef", ("abcd", "x", False), ("cdef", "y", False))
    assert clash["error"]["code"] == "overlapping_edits" and clash["after"] is None
    assert plan(spark, "abc", ("a", "x", False), ("zzzzzzzzzzzz", "y", False))["status"] == "failed"


def test_escapes(spark):
    assert plan(spark, "a\tb\nc", ("a\\tb\\nc", "x\\ny", False))["after"] == "x\ny"
    row = spark.createDataFrame([(r"\\n \q \" \t",)], "t string").select(edits.decoded("t").alias("d")).first()
    assert row["d"] == '\\n \\q " \t'


def test_fuzzy_edits(spark):
    text = "class A:\n    def run(self, first):\n        return 1\n\n    def stop(self):\n        return 2\n"
    got = plan(spark, text, ("def run(self, frst):\n    return 1", "def run(self):\n    return 3", False))
    assert got["matched_by"] == ["fuzzy"] and got["after"] == text.replace("    def run(self, first):\n        return 1\n", "    def run(self):\n        return 3\n")
    none = plan(spark, text, ("completely different words here", "x", False))
    assert none["error"]["code"] == "no_match" and len(none["error"]["lines"]) == 1
    two = plan(spark, "  foo bar baz\n  foo bar baz\n", ("FOO BAR BAZ", "x", False))
    assert two["error"]["code"] == "ambiguous_match" and two["error"]["lines"] == [1, 2]


def plain_dice(a, b):
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    return (x & y).total() * 2.0 / (len(a) - 1 + len(b) - 1)


def test_lines_are_scored_by_their_bigrams():
    rng = random.Random(4)
    for _ in range(60):
        lines = ["".join(rng.choices("abcé😀 ", k=rng.randrange(0, 12))) for _ in range(rng.randrange(0, 30))]
        held = edits.Bigrams(lines)
        for want in [*rng.sample(lines, min(3, len(lines))), "ab", "a", "zz top", "abcabc"]:
            assert held.dice(want).tolist() == [plain_dice(want, x) for x in lines]


def test_one_line_is_scored_without_an_index():
    rng = random.Random(6)
    for _ in range(60):
        lines = ["".join(rng.choices("abcé😀 ", k=rng.randrange(0, 12))) for _ in range(rng.randrange(0, 30))]
        for want in [*rng.sample(lines, min(3, len(lines))), "ab", "a", "zz top", "abcabc"]:
            assert edits.dice_of_lines(lines, want).tolist() == [plain_dice(want, x) for x in lines]


def test_fuzzy_lines_are_compared_whole(spark):
    head = "the same beginning of every line " * 8
    lines = [head + tail for tail in ("ends in apples and pears", "ends in nuts and bolts", "ends in rope and twine")]
    got = plan(spark, "\n".join(lines) + "\n", (lines[1].upper(), "found", False))
    assert got["matched_by"] == ["fuzzy"] and got["after"] == f"{lines[0]}\nfound\n{lines[2]}\n"
    asked = spark.createDataFrame([("f", 0, lines[2] + " zq", "x", False)], SCHEMA)
    row = edits.resolved(spark.createDataFrame([("f", f"{head[:160]}\n{lines[2]}\n")], "path string, content string"), asked).first()
    assert row["matched_by"] == "fuzzy" and row["dice"] == plain_dice(lines[2], lines[2] + " zq") < 1 and row["spans"][0]["start"] == 161
    far = plan(spark, head + "x" * 200 + "\n", (head + "y" * 200, "z", False))
    assert far["error"]["code"] == "no_match" and far["error"]["lines"] == [1]


def test_a_fuzzy_span_ends_with_its_line(spark):
    for text, span in (("one\n\nfoo bar baz", [5, 16]), ("one\r\nfoo bar baz\r\ntwo", [4, 16]), ("foo bar baz\n", [0, 12])):
        rows = spark.createDataFrame([("p", text)], "path string, content string")
        asked = spark.createDataFrame([("p", 0, "FOO bar  baz", "x", False)], "path string, edit_index int, search string, replace string, all boolean")
        got = edits.resolved(rows, asked).first()
        assert got["matched_by"] == "fuzzy" and [got["spans"][0]["start"], got["spans"][0]["end"]] == span
        assert got["spans"][0]["replacement"].endswith("\n") == (span[1] < len(text) or text.endswith("\n"))


def test_many_edits_of_a_long_file(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(3000)]
    lines = [f"    {i} " + " ".join(rng.choices(names, k=5)) for i in range(20_000)]
    at = sorted(rng.sample(range(20_000), 100))
    wanted = [(lines[i].strip()[:-2] + "Q!", f"changed {i}", False) for i in at]
    began = time.perf_counter()
    got = plan(spark, "\n".join(lines) + "\n", *wanted)
    assert time.perf_counter() - began < 60
    for i in at:
        lines[i] = f"    changed {i}"
    assert got["status"] == "applied" and got["edits_applied"] == 100 and set(got["matched_by"]) == {"fuzzy"}
    assert got["after"] == "\n".join(lines) + "\n"


def test_an_edit_without_a_search_is_invalid(spark):
    assert plan(spark, "a\nb\n", (None, "x", False))["error"]["code"] == "invalid_request"
    files = spark.createDataFrame([], "path string, content string")
    row = edits.planned(files, spark.createDataFrame([("g", 0, "a", "b", False)], SCHEMA)).first()
    assert row["status"] == "failed" and row["error"]["code"] == "file_not_found"


def test_line_ends_and_diff(spark):
    got = plan(spark, "a\r\nb\r\nc\r\n", ("b", "B\nB2", False))
    assert got["after"] == "a\r\nB\r\nB2\r\nc\r\n" and got["diff"] == ["-b", "+B", "+B2"]


def test_commit_and_file_actions(spark, tmp_path):
    (tmp_path / "f").write_text("old text\n")
    files = spark.createDataFrame([("f", "old text\n")], "path string, content string")
    made = edits.planned(files, spark.createDataFrame([("f", 0, "old", "new", False)], SCHEMA))
    assert edits.commit(made, str(tmp_path), dry_run=True)[0]["status"] == "applied" and (tmp_path / "f").read_text() == "old text\n"
    assert edits.commit(made, str(tmp_path))[0]["status"] == "applied" and (tmp_path / "f").read_text() == "new text\n"
    assert edits.commit(made, str(tmp_path))[0]["error"]["code"] == "hash_mismatch"
    act = lambda *a, **k: edits.file_action(str(tmp_path), *a, **k)
    assert act("create", "f")["error"]["code"] == "file_exists"
    assert act("create", "d/g", content="x")["status"] == "create" and act("move", "d/g", new_path="h")["path"] == "h"
    assert act("delete", "h")["status"] == "delete" and act("delete", "h")["error"]["code"] == "file_not_found"
    with pytest.raises(ValueError, match="outside_workspace"):
        act("create", "../x")


def brute(ranges, cut):
    points = sorted(set(p for a, b in ranges for p in range(a, b + 1)) - set(p for a, b in cut for p in range(a, b + 1)))
    out = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(x) for x in out]


def test_intervals(spark):
    mk = lambda rows: spark.createDataFrame([("k", a, b) for a, b in rows], "k string, start int, end int")
    got = sorted((r["start"], r["end"]) for r in intervals.normalise(mk([(5, 2), (6, 7), (20, 25), (-3, 0), (22, 99)]), "k").collect())
    assert got == [(1, 7), (20, 99)] or got == [(1, 1), (2, 7), (20, 99)]
    for ranges, cut in (([(1, 10)], [(3, 4), (4, 6)]), ([(1, 5), (8, 12)], [(5, 8)]), ([(1, 5)], [(1, 5)]), ([(1, 5)], [(9, 9)])):
        left = sorted((r["start"], r["end"]) for r in intervals.subtract(mk(ranges), mk(cut), "k").collect())
        assert left == brute(ranges, cut)


def run(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_a_real_repository(spark, tmp_path):
    run(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "a b.txt").write_text("1\n2\n3\n")
    (tmp_path / "c.txt").write_text("c\n")
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-qm", "first")
    (tmp_path / "a b.txt").write_text("1\nTWO\n3\n")
    (tmp_path / "new.txt").write_text("n\n")
    (tmp_path / "c.txt").unlink()
    lines = vcs.git_lines(spark, str(tmp_path), "status", "--porcelain=v2", "--branch")
    states = {(r["path"], r["state"]) for r in vcs.status_entries(lines).collect()}
    assert states == {("a b.txt", "unstaged"), ("c.txt", "deleted"), ("new.txt", "untracked")}
    assert vcs.branch_facts(lines).first()["branch"] == "main"
    diff = lambda *a: vcs.git_lines(spark, str(tmp_path), "diff", *a)
    files = {r["path"]: (r["status"], r["insertions"], r["deletions"]) for r in vcs.diff_files(diff("--numstat"), diff("--name-status")).collect()}
    assert files == {"a b.txt": ("M", 1, 1), "c.txt": ("D", 0, 1)}
    hunk = vcs.patch_hunks(diff()).where("path = 'a b.txt'").first()
    assert hunk["old_start"] == 1 and "+TWO" in hunk["patch"]
    log = vcs.log_entries(vcs.git_lines(spark, str(tmp_path), "log", "--pretty=format:%H\x1f%h\x1f%an\x1f%aI\x1f%s")).first()
    assert log["subject"] == "first" and log["author"] == "a"
    blame = vcs.blame_lines(vcs.git_lines(spark, str(tmp_path), "blame", "--porcelain", "HEAD", "--", "a b.txt")).orderBy("line").collect()
    assert [(r["line"], r["content"]) for r in blame] == [(1, "1"), (2, "2"), (3, "3")]
    assert {r["path"] for r in vcs.history(spark, str(tmp_path)).collect()} == {"a b.txt", "c.txt"}
    with pytest.raises(RuntimeError, match="git_failed"):
        vcs.git_lines(spark, str(tmp_path), "log", "nosuch")
    assert vcs.compare_args("back:2") == ["HEAD~2"] and vcs.compare_args("mergebase:x") == ["x...HEAD"]
    with pytest.raises(ValueError):
        vcs.compare_args("--output=x")


def test_diff_and_show(spark, tmp_path):
    run(tmp_path, "init", "-q", "-b", "main")
    for text in ("1\n", "1\n2\n"):
        (tmp_path / "f").write_text(text)
        run(tmp_path, "add", ".")
        run(tmp_path, "commit", "-qm", f"c{len(text)}")
    assert tuple(vcs.diff(spark, str(tmp_path), "back:1", "summary").first()) == (1, 1, 0)
    assert vcs.diff(spark, str(tmp_path), "back:1", "patches", max_lines=1).first()["omitted_lines"] == 2
    meta, changed = vcs.show(spark, str(tmp_path))
    assert meta.first()["subject"] == "c4" and changed.first()["path"] == "f"
    with pytest.raises(ValueError):
        vcs.show(spark, str(tmp_path), "--all")


def test_patches_and_blames_with_and_without_a_group(spark):
    """What lines carry from range to range: as a plain pass over them says, in whatever ranges they lie."""
    text, want, n = ["preamble", "@@ -9 +9 @@ not in a file"], [], 0
    for f in range(9):
        text += [f"diff --git a/f{f} b/f{f}", "--- a", "+++ b"]
        shown = 0
        for h in range(f % 4):
            own = [f"@@ -{h + 1},2 +{h + 5} @@ x"] + [f"+{f} {h} {k}" for k in range(f)]
            text += own
            kept = own[: max(0, 5 - shown)]
            shown += len(own)
            want.append((f"f{f}", h + 1, own[0], h + 1, h + 5, "\n".join(kept), len(own) - len(kept)))
    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, line string").repartition(3)
    columns = ["path", "hunk_no", "header", "old_start", "new_start", "patch", "omitted_lines"]
    took = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert took(vcs.patch_hunks(lines, 5)) == sorted(want)
    two = lines.withColumn("g", F.lit("a")).unionByName(lines.withColumn("g", F.lit(None).cast("string")))
    assert took(vcs.patch_hunks(two, 5, group="g")) == sorted(want * 2)
    uncut = took(vcs.patch_hunks(lines, None))
    assert [r[:5] for r in uncut] == [r[:5] for r in sorted(want)] and all(r[6] == 0 and r[5].startswith(r[2]) for r in uncut)
    blame, told = [], []
    for n in range(1, 31):
        sha = f"{n % 4:040x}"
        blame += [f"{sha} 1 {n} 1", *([f"author w{n % 4}", f"author-time {n % 4}"] if n <= 4 else []), f"\tline {n}"]
        told.append((n, sha[:8], f"w{n % 4}", f"line {n}"))
    rows = spark.createDataFrame(list(enumerate(blame)), "line_no int, line string").repartition(3)
    said = lambda df: sorted(tuple(r) for r in df.select("line", "sha_short", "author", "content").collect())
    assert said(vcs.blame_lines(rows)) == told == said(vcs.blame_lines(rows.withColumn("g", F.lit(1)), group="g"))
