import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import packaging, selection
from lodestone.plans import config, policy
from lodestone.sources import corpus, stores
from lodestone.streaming import incremental


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("DOT", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan_of_a_folder(spark, tmp_path):
    write(tmp_path, aDOTtxt="hello\n", binDOTdat=b"\x01\x00\x02", logDOTlog="x", sub__keepDOTlog="k", sub__dropDOTlog="d", node_modules__xDOTjs="1", vDOTminDOTjs="var a", lib__bigDOTpy="#" * 60)
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "sub" / ".gitignore").write_text("!keep.log\n")
    rows = {r["path"]: r for r in corpus.scan(spark, str(tmp_path), size_cap=50).collect()}
    assert {"a.txt", "bin.dat", "sub/keep.log", "v.min.js", "lib/big.py"} <= set(rows)
    assert not {"log.log", "sub/drop.log", "node_modules/x.js"} & set(rows)
    assert rows["bin.dat"]["is_binary"] and not rows["a.txt"]["is_binary"]
    assert rows["lib/big.py"]["oversized"] and rows["v.min.js"]["likely_generated"]
    assert rows["lib/big.py"]["language"] == "py"
    assert {r[0] for r in corpus.directories(corpus.scan(spark, str(tmp_path))).collect()} == {"sub", "lib"}


def test_generated_classifier(spark):
    cases = [("pnpm-lock.yaml", "a", True), ("x.bundle.css", "a", True), ("a.js", "x" * 400, True), ("a.js", "short\nlines\n", False), ("a.js", "", False)]
    rows = spark.createDataFrame([(p, t) for p, t, _ in cases], "p string, t string").select(corpus.likely_generated("p", "t").alias("g")).collect()
    assert [r["g"] for r in rows] == [e for _, _, e in cases]


def test_config_layers(tmp_path):
    home, root = tmp_path / "home", tmp_path / "root"
    (home / ".config/lodestone").mkdir(parents=True)
    root.mkdir()
    (home / ".config/lodestone/config.json").write_text(json.dumps({"caps": {"tree_tokens": 1, "search_chars": 2}}))
    (root / "lodestone.config.json").write_text(json.dumps({"caps": {"tree_tokens": 3}, "roots": ["x"]}))
    got = config.load(str(root), {"profile": "editor"}, {"LODESTONE_CAPS_SEARCH_CHARS": "9", "LODESTONE_TOOLS_GIT": "false", "LODESTONE_IGNORE_EXTRA": "a, b"}, str(home))
    assert got["caps"]["tree_tokens"] == 3 and got["caps"]["search_chars"] == 9 and got["roots"] == ["x"]
    assert got["tools"]["git"] is False and got["ignore"]["extra"] == ["a", "b"] and got["profile"] == "editor"
    assert config.DEFAULTS["caps"]["tree_tokens"] == 10_000
    for env in ({"LODESTONE_CAPS_TREE_TOKENS": "many"}, {"LODESTONE_TOOLS_GIT": "yes"}, {"LODESTONE_PROFILE": "guest"}):
        with pytest.raises(ValueError):
            config.load(str(root), None, env, str(home))


def test_policy(tmp_path):
    settings = config.merged(config.DEFAULTS, {"profile": "explorer", "tools": {"git": False}})
    assert policy.refusal("git", settings)["code"] == "tool_disabled_by_config"
    assert policy.refusal("apply_edits", settings)["code"] == "tool_disabled_by_profile"
    assert policy.refusal("read_file", settings) is None
    assert policy.narrower("full", "explorer") == "explorer"
    for tool, bad in (("read_file", {}), ("read_file", {"paths": ["x"] * 33}), ("apply_edits", {"search": "a"}), ("get_file_tree", {"max_tokens": 60_000})):
        with pytest.raises(ValueError):
            policy.checked(tool, bad)
    closed = []
    for k in range(3):
        (tmp_path / str(k)).mkdir()
    roots = policy.Roots(lambda r: r, most=2, close=closed.append)
    for k in (0, 1, 0, 2):
        roots.get(str(tmp_path / str(k)))
    assert closed == [str((tmp_path / "1").resolve())]
    with pytest.raises(ValueError):
        policy.valid_root("relative")


def test_stores_and_export(spark, tmp_path):
    stores.write_json(tmp_path / "a.json", {"k": 1})
    assert stores.read_json(tmp_path / "a.json") == {"k": 1}
    (tmp_path / "b.json").write_text("{")
    assert stores.read_json(tmp_path / "b.json") is None and stores.read_json(tmp_path / "c.json") is None
    sections = spark.createDataFrame([("s", "user_instructions", "do it"), ("s", "git_diff", " ")], "session_id string, section string, text string")
    made = packaging.payload(sections)
    receipts = spark.createDataFrame([("s", "{}")], "session_id string, receipt string")
    text, receipt = stores.export_payload(made, receipts, "s", str(tmp_path), datetime(2024, 1, 2))
    assert text.read_text() == "<user_instructions>\ndo it\n</user_instructions>" and receipt.name.startswith("20240102-")


def test_payload_order_and_prompts(spark):
    rows = [("s", "user_instructions", "u"), ("s", "file_map", "m"), ("s", "other", "o"), ("s", "meta_prompts", packaging.meta_prompts(["MVP", 'a"b']))]
    text = packaging.payload(spark.createDataFrame(rows, "session_id string, section string, text string"), instructions_first=True).first()["text"]
    assert text.index("<user_instructions>") == 0 < text.index("<file_map>") < text.index("<meta prompt 1") < text.rindex("<user_instructions>") < text.index("<other>")
    assert 'name' not in text and '= "a&quot;b"' in text


def test_blocks_with_slices_and_missing_files(spark):
    files = spark.createDataFrame([("a.py", "1\n2\n3\n")], "path string, content string")
    entry = lambda p: spark.createDataFrame([("s", p, "slices", [(2, 3, "why")])], f"session_id string, path string, mode string, slices {selection.SLICES}")
    block = packaging.file_blocks(entry("a.py"), files).first()["block"]
    assert block == "File: a.py\n(lines 2-3: why)\n```py\n2\n3\n```"
    with pytest.raises(Exception, match="no such file"):
        packaging.file_blocks(entry("b.py"), files).collect()


def test_sessions_are_saved_apart(spark, tmp_path):
    files = spark.createDataFrame([("a.txt", "x\n"), ("b.txt", "y\n")], "path string, content string")
    entries = spark.createDataFrame([("s1", "a.txt", "full", []), ("s2", "b.txt", "full", [])], f"session_id string, path string, mode string, slices {selection.SLICES}")
    selection.save(selection.measured(entries, files), str(tmp_path / "t"))
    selection.save(selection.measured(entries.where("session_id = 's1'").withColumn("path", F.lit("b.txt")), files), str(tmp_path / "t"))
    assert [r["path"] for r in selection.load(spark, str(tmp_path / "t"), "s1").collect()] == ["b.txt"]
    assert [r["path"] for r in selection.load(spark, str(tmp_path / "t"), "s2").collect()] == ["b.txt"]
    grown = selection.set_mode(selection.load(spark, str(tmp_path / "t"), "s1"), entries.where("session_id = 's1'").withColumn("path", F.lit("b.txt")).select("session_id", "path"), "codemap")
    assert grown.first()["mode"] == "codemap"
    assert selection.forget(grown, files).count() == 0


def test_stream_adds_only_new_contents(spark, tmp_path):
    table, folder, checkpoint = (str(tmp_path / n) for n in ("table", "in", "cp"))
    schema = "path string, content string"
    for rows in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        incremental.follow(spark, folder, schema, table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == 3
    incremental.fold(spark.createDataFrame([("a", "1")], schema), 7, table)
    assert spark.read.parquet(table).count() == 3
    assert {r["path"]: r["batch"] for r in incremental.current(spark, table).collect()} == {"a": 0, "b": 1}


def test_views_and_prompts(spark):
    files = spark.createDataFrame([("a.py", "1\n2\n3\n"), ("b.py", "b\n")], "path string, content string")
    rows = [("s", "a.py", "slices", [(3, 2, None)]), ("s", "b.py", "codemap", [])]
    entries = spark.createDataFrame(rows, f"session_id string, path string, mode string, slices {selection.SLICES}")
    maps = spark.createDataFrame([("b.py", "File: b.py\n")], "path string, text string")
    held = selection.measured(entries, files, maps)
    assert selection.view(held, "content", files).first()["text"] == "2\n3\n"
    assert selection.view(held, "codemaps", codemaps=maps).first()["text"] == "File: b.py\n"
    assert {r["mode"]: r["tokens"] for r in selection.view(held, "files").collect()} == {"slices": 2, "codemap": 3}
    assert selection.view(held, "summary").first()["total_tokens"] == 5
    log = [("s", 1, "set", "old"), ("s", 2, "clear", None), ("s", 3, "append", "a"), ("s", 4, "append", "b"), ("t", 1, "append", "x")]
    told = selection.prompts_after(spark.createDataFrame(log, "session_id string, at int, action string, text string"))
    assert {r["session_id"]: r["prompt"] for r in told.collect()} == {"s": "ab", "t": "x"}
