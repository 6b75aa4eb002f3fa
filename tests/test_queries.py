import hashlib
import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.plans import queries
from lodestone.plans.tables import files, selected, table
from tests.oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_sql_gives(spark, name):
    mine, theirs = both(spark, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows_and_names_match(spark):
    df = __spark_entry__.entry(spark)
    assert {"path", "rank", "tokens"} <= set(df.columns)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_whole_selection_is_packaged_in_bounded_sessions(spark, monkeypatch):
    monkeypatch.setattr(queries, "BUNDLE_TOKENS", 3000)
    content = {r["path"]: r["content"] for r in files(spark, SF).select("path", "content").collect()}
    mode = {r["path"]: r["mode"] for r in selected(spark, SF).collect()}
    records = {r["session_id"]: json.loads(r["receipt"]) for r in queries.QUERIES["receipt"](spark, SF).collect()}
    hashes = {r["session_id"]: r["content_sha256"] for r in queries.QUERIES["payload_hash"](spark, SF).collect()}
    sums = {r["session_id"]: r["files_full"] for r in queries.QUERIES["token_breakdown"](spark, SF).collect()}
    held = [f["path"] for r in records.values() for f in r["files"]]
    assert sorted(held) == sorted(mode) and len(records) > 4
    assert hashes.keys() == records.keys() == sums.keys()
    for session, record in records.items():
        blocks = ["File: " + f["path"] + "\n```txt\n" + re.sub(r"\s+$", "", content[f["path"]]) + "\n```" for f in record["files"] if f["mode"] == "full"]
        body = "<file_contents>\n" + "\n\n".join(blocks) + "\n</file_contents>\n\n" if blocks else ""
        text = body + "<user_instructions>\nExplain.\n</user_instructions>"
        assert hashes[session] == record["content_hash"] == hashlib.sha256(text.encode()).hexdigest()
        assert sums[session] == sum(f["tokens"] for f in record["files"])
        assert sum(f["tokens"] for f in record["files"][:-1]) <= 3000


def test_ranges_of_all_orders_are_subtracted(spark):
    lines = defaultdict(list)
    for r in table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q")).collect():
        lines[r["l_orderkey"]].append((r["l_linenumber"], r["q"]))
    want = set()
    for key, own in lines.items():
        cut = {x for n, q in own for x in range(n * 20 + 5, n * 20 + 5 + q % 12 + 1)}
        left = [x for x in range(min(own)[0] * 20, max(own)[0] * 20 + 31) if x not in cut]
        starts = [x for k, x in enumerate(left) if k == 0 or left[k - 1] != x - 1]
        ends = [x for k, x in enumerate(left) if k == len(left) - 1 or left[k + 1] != x + 1]
        want |= {(key, a, b) for a, b in zip(starts, ends, strict=True)}
    got = [(r["key"], r["start"], r["end"]) for r in queries.QUERIES["interval_difference"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and any(k % 4 for k, _, _ in got)


def test_fuzzy_edits_are_resolved_among_all_lines(spark):
    rows = {r["path"]: r for r in queries.QUERIES["edit_fuzzy"](spark, SF).collect()}
    content = {r["path"]: r["content"] for r in files(spark, SF).select("path", "content").collect()}
    assert rows.keys() == {p for p, t in content.items() if t.strip()}
    found = [r for r in rows.values() if r["matched_by"] == "fuzzy"]
    assert len(found) > 20 and all(0 < r["dice"] <= 1 and r["code"] is None for r in found)
    lines_met = {content[r["path"]][: r["start"]].count("\n") + 1 for r in found} | {n for r in rows.values() for n in r["lines"] or []}
    assert max(lines_met) > 3  # lines after the first three take part
    for r in found:
        text = content[r["path"]]
        assert (r["start"] == 0 or text[r["start"] - 1] == "\n") and (r["end"] == len(text) or text[r["end"] - 1] == "\n")


def test_code_made_of_suppliers_is_read_by_all_tasks(spark):
    assert queries.QUERIES["codemap_languages"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_parts_of_the_subtraction_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "PART_ROWS", 500)
    parts = -(-table(spark, SF, "lineitem").count() // 500)
    got = queries.QUERIES["interval_difference"](spark, SF)
    assert parts > 4 and got.rdd.getNumPartitions() == parts
