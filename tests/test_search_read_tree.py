import pytest
from pyspark.sql import functions as F

from lodestone.operators import read, search, tree

FILES = [("src/a.txt", "one\ntwo Key\nthree\nKey four\nfive\n"), ("src/b.txt", "nothing\n"), ("lib/é.txt", "éé Key\n"), ("lib/bin", "Key")]


@pytest.fixture
def files(spark):
    rows = spark.createDataFrame(FILES, "path string, content string")
    return rows.withColumn("is_binary", F.col("path") == "lib/bin")


def test_content_matches(files):
    rows = sorted(map(tuple, search.content_matches(search.searchable(files), "Key").collect()))
    assert rows == [("lib/é.txt", 1, 6, "Key"), ("src/a.txt", 2, 5, "Key"), ("src/a.txt", 4, 1, "Key")]
    assert search.content_matches(files, "K.y", regex=True).count() == 4
    assert search.content_matches(files, "Ke", whole_word=True).count() == 0
    with pytest.raises(ValueError):
        search.pattern_of("(?=x)", regex=True)


def test_context_lines_are_shown_once(files):
    hits = search.with_context(search.content_matches(files, "Key"), search.line_table(files), 1)
    rows = {(r["path"], r["line"]): (r["context_before"], r["context_after"]) for r in hits.collect()}
    assert rows[("src/a.txt", 2)] == (["one"], [])
    assert rows[("src/a.txt", 4)] == (["three"], ["five"])
    assert rows[("lib/é.txt", 1)] == ([], [])
    again = search.content_matches(files, "Key", around=1)
    assert {(r["path"], r["line"]): (r["context_before"], r["context_after"]) for r in again.collect()} == rows


def test_caps_of_an_answer(files):
    kept, caps = search.answer(files, "Key", context_lines=1, max_results=2)
    assert kept.count() == 2 and tuple(caps.first())[:2] == (True, 2 + search.found(files, "Key").count() - 4)
    assert tuple(search.answer(files, "nowhere", max_results=2)[1].first()) == (False, 0, None)


@pytest.fixture
def many(spark):
    """(files, opened): 400 files in an order of their own; `opened` counts those whose content was looked at."""
    opened = spark.sparkContext.accumulator(0)

    def content(n):
        opened.add(1)
        return f"Key {n}\nplain\nsecond Key\n" if n % 5 == 0 else "plain\n"

    paths = spark.range(400).selectExpr("CAST(id AS INT) AS n", "concat('d', id * 7 % 11, '/é', id, '.txt') AS path")
    return paths.select("path", F.udf(content)("n").alias("content")), opened


def in_order(rows):
    return sorted(rows, key=lambda r: (r["path"].encode(), r["line"]))


@pytest.mark.parametrize("most", [1, 2, 7, 60, 159, 160, 161, 1000])
def test_first_matches_are_the_first_of_all(many, most):
    files, _ = many
    whole = in_order(search.content_matches(files, "Key", around=1).collect())
    rows, more = search.first_matches(files, "Key", most, around=1)
    assert in_order(rows.collect()) == whole[:most] and len(whole) == 160
    assert more == (most < 160)


def test_an_early_stop_leaves_the_rest_unread(many):
    files, opened = many
    rows, more = search.first_matches(files, "Key", 4)
    assert rows.count() == 4 and more
    assert 0 < opened.value < 200  # both passes together, of 400 files


def test_bytes_shown_stop_a_search(many):
    files, _ = many
    whole = in_order(search.content_matches(files, "Key").collect())
    for shown, kept in ((0, 1), (2, 1), (3, 2), (29, 10), (30, 11)):  # three bytes a match; the one that exceeds is the last
        rows, more = search.first_matches(files, "Key", 1000, shown_bytes=shown)
        assert in_order(rows.collect()) == whole[:kept] and more
    rows, more = search.first_matches(files, "Key", 1000, shown_bytes=3 * 160 - 1)
    assert rows.count() == 160 and not more


def test_first_matches_of_nothing(spark, files):
    none = spark.createDataFrame([(None, "Key"), ("a", None), ("b", "")], "path string, content string")
    for rows in (none, none.limit(0)):
        got, more = search.first_matches(rows, "Key", 5)
        assert got.count() == 0 and not more
    with pytest.raises(ValueError):
        search.first_matches(files, "Key", 0)


def test_a_search_that_stops_early_ranks_what_it_has(files, many):
    assert search.search(files, "Key", stop_early=True).collect() == search.search(files, "Key").collect()
    assert search.search(files, "a.txt", mode="path", stop_early=True).collect() == search.search(files, "a.txt", mode="path").collect()
    kept, told = search.answer(many[0], "Key", mode="content", stop_early=True, max_results=5)
    assert [r["path"] for r in kept.orderBy("rank").collect()] == [r["path"] for r in in_order(search.content_matches(many[0], "Key").collect())[:5]]
    assert tuple(told.first())[:2] == (True, None)
    whole = search.answer(files, "Key", stop_early=True, max_results=50)[1]
    assert tuple(whole.first()) == (False, 0, None)


def test_search_modes_and_summary(spark, files):
    assert search.resolve_mode("a/b") == "path" and search.resolve_mode("ab") == "both"
    found = search.search(files, "a.txt", mode="path")
    assert found.orderBy("rank").first()["path"] == "src/a.txt"
    every = search.search(files, "Key", max_results=50)
    kept = search.shaped(every, 2, 10_000)
    s = search.summary(every, kept).first()
    assert s["limit_hit"] and s["omitted_total"] == every.count() - 2
    assert search.shaped(every, 50, 10).count() == 0


def test_rank_prefers_definitions(spark):
    rows = [("a", 1, "class Thing", 0.0, 1), ("b", 1, "x = Thing()", 0.0, 0)]
    matches = spark.createDataFrame(rows, "path string, line int, match_text string, score double, position int")
    index = spark.createDataFrame([("Thing", "a")], "type_name string, path string")
    assert search.ranked(matches, type_index=index).orderBy("rank").first()["path"] == "a"


def test_slices(spark):
    five = spark.createDataFrame([("x", "1\n2\n3\n4\n5")], "path string, content string")
    get = lambda *a: tuple(read.slice_lines(five, *a).first())[1:]
    assert get(2, 2) == ("2\n3\n", 5, 2, 3)
    assert get(-2) == ("4\n5", 5, 4, 5)
    assert get(0, 1) == ("1\n", 5, 1, 1)
    assert get(9, 2)[0] == "" and get(-9)[0] == "1\n2\n3\n4\n5"


def test_batch_shares_the_cap(spark):
    files = spark.createDataFrame([("a", "x" * 41), ("b", "y" * 5)], "path string, content string")
    asked = spark.createDataFrame([(0, "a"), (1, "b"), (2, "gone")], "request_idx int, path string")
    rows = read.read_batch(asked, files, 30).orderBy("request_idx").collect()
    assert [(r["found"], r["text"], r["omitted"]) for r in rows] == [(True, "x" * 10, 31), (True, "y" * 5, 0), (False, None, 0)]


def test_tree_rendering_and_ladder(spark):
    paths = [f"area{a}/mod{m}/file{f}.py" for a in range(4) for m in range(4) for f in range(20)] + ["src/deep/er/x.py", "README.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    nodes = tree.rollup(df)
    counts = {r["prefix"]: (r["file_count"], r["dir_count"]) for r in nodes.collect()}
    assert counts[""] == (322, 23) and counts["area1"] == (80, 4) and counts["src"] == (1, 2)
    marked = tree.anchors(nodes, df.where("path = 'src/deep/er/x.py'"))
    whole = tree.render(marked, max_tokens=100_000)
    assert not whole["limit_hit"] and "x.py *" in whole["tree"] and whole["tree"].startswith(tree.HEAD)
    for most in (900, 300, 120, 60):
        got = tree.render(marked, max_tokens=most)
        assert got["limit_hit"] and "x.py *" in got["tree"]
        assert tree._estimate(got["tree"]) <= most or got["chosen_depth"] == 0
    assert tree.render(marked, mode="selected", have_selection=False) == {"error": {"code": "not_available_until_selection"}}
    folders = tree.render(marked, mode="folders")["tree"]
    assert "mod3" in folders and "file1.py" not in folders


def drawn(nodes, shape, prefix="", lead="", cap_open=True):
    """Lines of a small tree below a node, drawn by recursion over its children."""
    node = nodes[prefix]
    anchored = lambda n: n["anchor_self"] or n["anchor_descendant"]
    level = node["depth"]
    below = [n for n in nodes.values() if n["depth"] == level + 1 and (prefix == "" or n["prefix"].startswith(prefix + "/"))]
    if shape.folders:
        below = [n for n in below if n["kind"] == "dir" or n["selected"]]
    if shape.anchored_only and not node["anchor_descendant"]:
        below = [n for n in below if anchored(n) or n["heuristic_anchor"]]
    below.sort(key=lambda n: (n["kind"] == "file", n["prefix"].encode()))
    more = False
    if cap_open and shape.depth is not None and level >= shape.depth:
        kept = [n for n in below if anchored(n)]
        below, more, cap_open = kept, len(below) > len(kept) and bool(kept), False
    if shape.distant is not None and level >= shape.distant and not anchored(node):
        below = []
    found = []
    for i, n in enumerate(below):
        last = i == len(below) - 1 and not more
        name = n["prefix"].rsplit("/", 1)[-1]
        short = n["kind"] == "dir" and not (anchored(n) and not (shape.depth == n["depth"] and cap_open and not n["anchor_descendant"])) and (shape.staged or (shape.depth == n["depth"] and cap_open) or (shape.distant is not None and n["depth"] >= shape.distant))
        label = f"{name}/ {summed(n)}" if short else name + (" *" if n["selected"] else "")
        found.append(lead + ("└── " if last else "├── ") + label)
        found += drawn(nodes, shape, n["prefix"], lead + ("    " if last else "│   "), cap_open)
    return found + ([lead + "└── " + summed(node)] if more else [])


def summed(n):
    return "… (" + ", ".join(f"{k} {w}{'s' * (k != 1)}" for k, w in ((n["file_count"], "file"), (n["dir_count"], "dir")) if k) + ")"


def test_lines_are_those_of_a_recursive_drawing(spark, monkeypatch):
    paths = [f"a{i}/b{j}/c{k}/d{m}.txt" for i in range(3) for j in range(2) for k in range(3) for m in range(2)] + ["a1/b.txt", "z.md", "b-x/y", "src/deep/er/x/y/z.py", "a1/b1x/q"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    marked = tree.anchors(tree.rollup(df), df.where("path IN ('a1/b1/c2/d0.txt', 'src/deep/er/x/y/z.py', 'a1/b0/c0')"))
    nodes = {r["prefix"]: r.asDict() for r in marked.collect()}
    placed = tree.placed(marked).cache()
    shapes = [tree.Shape(folders=f, depth=d, staged=s) for f in (False, True) for d in (None, 0, 1, 2, 3) for s in (False, True)] + [tree.Shape(distant=d, folders=f) for d in (1, 2, 4) for f in (False, True)] + [tree.Shape(anchored_only=True), tree.Shape(anchored_only=True, distant=1)]
    for shape in shapes:
        got = [r["line"] for r in tree.lines(placed, shape).orderBy("place").collect()]
        assert got[1:] == drawn(nodes, shape) and got[0].startswith("."), shape
        assert tree.Ladder(placed, 0).least_bytes(shape) <= len(tree._text([{"line": x} for x in got]).encode())
    monkeypatch.setattr(tree, "MOST_LINES", 5)
    short = tree.render(marked, mode="full")
    assert short["limit_hit"] and short["omitted_total"] == len(nodes) - 5 and short["tree"].count("\n") == 6
    monkeypatch.setattr(tree, "MOST_LINES", 2)
    last = tree.render(marked, max_tokens=1)
    whole = drawn(nodes, tree.Shape(anchored_only=True, distant=1))
    assert last["shape"] == "root summaries" and last["omitted_total"] == len(whole) + 1 - 2 and last["tree"].count("\n") == 3
    assert tree.render(tree.anchors(tree.rollup(df.limit(0)), df.limit(0)))["tree"] == tree.HEAD + "\n"


def test_numbers_over_ranges(spark):
    from lodestone.operators import ordering

    rows = spark.range(1000).selectExpr("id % 37 AS a", "id AS b", "'x' AS c").repartition(5)
    got = ordering.numbered(rows, [F.desc("a"), "b"], "n", first=1).collect()
    want = sorted(((i % 37, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert sorted((r["n"], r["a"], r["b"]) for r in got) == [(k, *r) for k, r in enumerate(want, 1)]
    assert ordering.numbered(rows.limit(0), ["a"], "n").count() == 0


def test_boosts_count_among_all_matches_and_not_only_the_first(spark):
    texts = [(f"a/{k:03d}.txt", f"before {k}\nthe Key {k}\nafter {k}\n") for k in range(120)] + [("z/late.txt", "x\nKey Late\ny\n"), ("z/recent.txt", "u\nKey\nv\n")]
    many = spark.createDataFrame(texts, "path string, content string")
    types = spark.createDataFrame([("Key", "z/late.txt")], "type_name string, path string")
    recent = spark.createDataFrame([("z/recent.txt", 0)], "path string, rank int")
    rows = search.search(many, "Key", mode="content", context_lines=1, context_paths=["z/x.txt"], type_index=types, recent=recent, max_results=50).orderBy("rank").collect()
    score = {p: 1000.0 - k + (40 if p.startswith("z/") else 0) + (2000 if p == "z/late.txt" else 0) + (200 if p == "z/recent.txt" else 0) for k, (p, _) in enumerate(sorted(texts))}
    want = sorted(score, key=lambda p: (-score[p], p))[:50]
    assert [(r["rank"], r["path"], r["score"]) for r in rows] == [(k, p, score[p]) for k, p in enumerate(want, 1)]
    assert want[0] == "z/late.txt" and "z/recent.txt" in want
    assert (rows[0]["context_before"], rows[0]["context_after"]) == (["x"], ["y"])
    # more matching paths than the limit do not keep a boosted content match out
    named = many.withColumn("path", F.concat(F.lit("Key/"), "path"))
    types = types.withColumn("path", F.concat(F.lit("Key/"), "path"))
    first = search.search(named, "Key", mode="both", type_index=types, max_results=50).orderBy("rank").first()
    assert (first["path"], first["kind"], first["line"]) == ("Key/z/late.txt", "content", 2)


SESSIONS = [("one", "a/b/c.py", "full"), ("one", "a/b/d.py", "codemap"), ("one", "a/e", "slices"), ("one", "z", "codemap"), ("two", "a/b/c.py", "codemap"), ("two", "q/r.xcassets/s", None), ("three", "a", "full"), ("three", "a/b", "full")]


def test_trees_of_many_sessions_are_those_of_each(spark):
    given = [*SESSIONS, ("one", "a/b/c.py", "full"), ("two", "a/b/c.py", "full"), ("one", None, "full"), (None, "x", "full")]
    entries = spark.createDataFrame(given, "session_id string, path string, mode string")
    got = tree.of_sessions(entries).orderBy("session_id", "place").collect()
    assert {r["session_id"] for r in got} == {"one", "two", "three"}
    for session in ("one", "two", "three"):
        own = entries.where(F.col("session_id") == session)
        plain = tree.anchors(tree.rollup(own), own.where("mode IS NULL OR mode <> 'codemap'").where("path IS NOT NULL"), own.where("mode = 'codemap'"))
        alone = tree.lines(tree.placed(plain), tree.Shape(staged=False)).orderBy("place").collect()
        assert [r["line"] for r in got if r["session_id"] == session] == [r["line"] for r in alone]
    assert [r["line"] for r in got if r["session_id"] == "one"] == [".", "├── a", "│   ├── b", "│   │   ├── c.py *", "│   │   └── d.py +", "│   └── e *", "└── z +"]
    assert tree.of_sessions(entries.limit(0)).count() == 0
