import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def tokens(text):
    units = len(text.encode("utf-16-le")) // 2
    base = math.ceil(len(text.encode()) / 4 * 1.05)
    cjk = sum(1 for c in text if "\u4e00" <= c <= "\u9fff" or "\u3040" <= c <= "\u30ff" or "\uac00" <= c <= "\ud7a3")
    mult = (1.3 if units and cjk / units > 0.1 else 1.0) * (0.8 if units / (text.count("\n") + 1) > 100 and text.count(";") > units * 0.01 else 1.0)
    return math.ceil(base * mult)


@pytest.mark.parametrize("text", ["", "a", "hello world\n" * 9, "漢字かな交じり文", "var a=1;" * 40, "a😀b"])
def test_token_estimate(spark, text):
    assert one(spark, T.estimate_tokens("t"), t=text) == tokens(text)


def test_lengths_and_lines(spark):
    assert one(spark, T.utf16_length("t"), t="a😀") == 3
    assert one(spark, T.lines_kept("t"), t="a\r\nb\n\nc") == ["a\r\n", "b\n", "\n", "c"]
    assert one(spark, T.lines("t"), t="a\r\nb\n") == ["a", "b"]
    assert one(spark, T.lines_kept("t"), t="") == []


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("  Public   STATIC foo =", "static foo"), ("x\u00a0y ->", "x y"), ("// ======= head", "// - head"), ("async run():", "run()"), ("=" * 3, "==")],
)
def test_normalised_line(spark, raw, expected):
    assert one(spark, T.normalised_line("t"), t=raw) == expected


def test_long_lines_are_normalised_whole(spark):
    raw = "Static " + "Word " * 80 + "end   =>"
    assert one(spark, T.normalised_line("t"), t=raw) == "word " * 80 + "end"
    for same in ("a =\u2028", "a >", "a -> b", "a\u0085"):
        assert one(spark, T.normalised_line("t"), t=same) == same
    assert [one(spark, T.normalised_line("t"), t=f"a\u00a0 {sign}") for sign in (*T.TRAILING, "==")] == ["a"] * 5 + ["a ="]
    assert one(spark, T.normalised_head("t", 12), t=raw) == "word word wo" and one(spark, T.normalised_head("t", 5), t="ab ->cd") == "ab"


def dice(a, b):
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = [[s[i : i + 2] for i in range(len(s) - 1)] for s in (a, b)]
    shared = sum(min(x.count(g), y.count(g)) for g in set(x))
    return 2 * shared / (len(x) + len(y))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab c", max_size=8), st.text("ab c", max_size=8)), min_size=1, max_size=30))
def test_multiset_dice_by_brute_force(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.multiset_dice(F.col("a"), F.col("b")).alias("d")).collect()
    for r in rows:
        assert r["d"] == pytest.approx(dice(r["a"], r["b"]))


def test_filters(spark):
    df = spark.createDataFrame([("src/a.ts",), ("src/a.tsx",), ("srcs/b.ts",), ("lib/node_modules/x.js",)], "path string")
    names = lambda c: sorted(r[0] for r in df.where(c).collect())
    assert names(P.under("path", ["./src/"])) == ["src/a.ts", "src/a.tsx"]
    assert names(P.with_extension("path", [".ts"])) == ["src/a.ts", "srcs/b.ts"]
    assert names(P.not_excluded("path", ["*.tsx", "node_modules"])) == ["src/a.ts", "srcs/b.ts"]
    assert names(P.hard_ignored("path")) == ["lib/node_modules/x.js"]


@pytest.mark.parametrize(
    ("rules", "path", "expected"),
    [
        (["*.log"], "a/b/x.log", True), (["*.log", "!keep.log"], "a/keep.log", False), (["/top.txt"], "a/top.txt", False), (["/top.txt"], "top.txt", True),
        (["vendor/**"], "vendor/a/b", True), (["doc/"], "a/doc/x", True), (["doc/"], "doc", False), (["**/*.xib"], "v/x.xib", True), (["a[0-9].c"], "a7.c", True),
        (["# no", "", "!x"], "x", False), (["a/b"], "z/a/b", False), (["?.md"], "ab.md", False),
    ],
)
def test_ignore_rules(spark, rules, path, expected):
    assert one(spark, P.ignored("p", rules), p=path) is expected


def test_rules_of_nested_ignore_files():
    assert P.rebased("sub", "!keep.txt") == ["!sub/keep.txt", "!sub/**/keep.txt"]
    assert P.rebased("sub", "/a/b") == ["sub/a/b"]
    assert P.rebased("", "x") == ["x"]
    assert P.rule_to_regex("# c") is None
    assert re.match(P.rule_to_regex("a/**/b")[1], "a/x/y/b")


@pytest.mark.parametrize(("path", "expected"), [("a.TS", "ts"), ("x/Package.swift", "swift"), ("a.h", "c"), ("a.hpp", "cpp"), ("Makefile", None), (".ts", None)])
def test_language(spark, path, expected):
    assert one(spark, P.language("p"), p=path) == expected
