import json
import subprocess

import pytest

from lodestone.operators import edits, packaging, selection, tree
from lodestone.plans import cli, policy, tools
from lodestone.sources import vcs


@pytest.fixture
def space(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    root = tmp_path / "w"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("from b import Base\nclass Key(Base):\n    def turn(self):\n        return 1\n")
    (root / "src/b.py").write_text("class Base:\n    pass\n")
    (root / "note.txt").write_text("one\nKey two\n")
    return tools.Workspace(spark, str(root))


def test_a_workspace_from_search_to_export(space):
    found = space.call("file_search", {"pattern": "Key", "context_lines": 1, "max_results": 1})
    assert len(found["matches"]) == 1 and found["limit_hit"] and found["omitted_total"] == 1
    got = space.call("read_file", {"paths": ["note.txt", "gone"], "start_line": 2})
    assert [(f["found"], f["text"]) for f in got["files"]] == [(True, "Key two\n"), (False, None)]
    assert "a.py" in space.call("get_file_tree", {})["tree"]
    shown = space.call("get_code_structure", {"paths": ["src"], "max_results": 1})
    assert shown["omitted_total"] == 1 and "Key" in shown["files"][0]["text"]
    assert space.call("manage_selection", {"op": "add", "paths": ["src/a.py"]})["selection"][0]["files"] == 2  # with the file that defines Base
    assert space.call("manage_selection", {"op": "add", "paths": ["nowhere"], "strict": True})["error"]["code"] == "not_found"
    space.call("manage_selection", {"op": "save_profile", "name": "mine"})
    assert space.call("prompt", {"op": "set", "text": "Do it."}) == {"prompt": "Do it."}
    out = space.call("workspace_context", {"op": "export", "preset": "plan"})
    text = open(out["payload"]).read()
    assert "<file_map>" in text and "File: src/b.py" in text and "File: src/a.py\n```py" in text and "Architect" in text and "Do it." in text
    assert json.load(open(out["receipt"]))["preset"] == "plan"
    assert space.call("manage_selection", {"op": "clear"})["selection"] == [] and space.call("prompt", {"op": "get"})["prompt"] == ""
    assert space.call("manage_selection", {"op": "list_profiles"}) == {"profiles": ["mine"]}
    assert space.call("manage_selection", {"op": "load_profile", "name": "mine", "view": "files"})["selection"][0]["path"] == "src/a.py"


def test_edits_drop_what_was_derived(space):
    done = space.call("apply_edits", {"path": "note.txt", "search": "one", "replace": "1"})
    assert done["status"] == "applied" and done["post_context"] == [{"start_line": 1, "end_line": 1, "text": "1: 1\n2: Key two"}]
    assert space.call("read_file", {"path": "note.txt"})["files"][0]["text"] == "1\nKey two\n"
    made = space.call("apply_edits", {"path": "new/c.txt", "rewrite": "x\r\ny", "on_missing": "create"})
    assert made["file_created"] and space.call("read_file", {"path": "new/c.txt"})["files"][0]["text"] == "x\r\ny"
    assert space.call("apply_edits", {"path": "gone.txt", "rewrite": "x"})["error"]["code"] == "file_not_found"
    assert space.call("apply_edits", {"path": "../x", "rewrite": "x"})["error"]["code"] == "outside_workspace"
    assert space.call("file_actions", {"action": "delete", "path": "new/c.txt"})["status"] == "delete"
    assert "new/c.txt" not in {m["path"] for m in space.call("file_search", {"pattern": "*c.txt"})["matches"]}


def test_rewrites_keep_the_shape_of_a_file(spark):
    files = spark.createDataFrame([("a", "1\r\n2\r\n"), ("b", "1\n2"), ("c", "")], "path string, content string")
    new = spark.createDataFrame([("a", "x\ny"), ("b", "x\ny\n"), ("c", None), ("d", "x\r\n")], "path string, rewrite string")
    after = {r["path"]: (r["status"], r["after"]) for r in edits.rewritten(files, new, create=True).collect()}
    assert after == {"a": ("applied", "x\r\ny\r\n"), "b": ("applied", "x\ny"), "c": ("applied", ""), "d": ("applied", "x\r\n")}
    assert edits.rewritten(files, new).where("path = 'd'").first()["error"]["code"] == "file_not_found"


def test_context_follows_moved_text(spark):
    text = "".join(f"{n}\n" for n in range(1, 21))
    files = spark.createDataFrame([("a", text)], "path string, content string")
    wanted = spark.createDataFrame([("a", 0, "\n2\n", "\nx\ny\n", False), ("a", 1, "\n15\n", "\nz\n", False)], "path string, edit_index int, search string, replace string, `all` boolean")
    found = edits.planned(files, wanted).first()["post_context"]
    assert [(c["start_line"], c["end_line"]) for c in found] == [(1, 3), (15, 16)]
    assert found[1]["text"] == "\n".join(f"{n}: {'z' if n == 16 else n - 1}" for n in range(12, 20))


def test_file_map_by_usage(spark):
    entries = spark.createDataFrame([("s", "b", "codemap", True), ("s", "a", "codemap", False), ("s", "c", "full", False)], "session_id string, path string, mode string, auto boolean")
    maps = spark.createDataFrame([(p, f"File: {p}\n---\n") for p in "abc"], "path string, text string")
    trees = spark.createDataFrame([("s", ".\n")], "session_id string, tree string")
    text = lambda usage, t=None: [r["text"] for r in packaging.file_map(entries, maps, usage, t).collect()]
    assert text("auto", trees) == [".\n\nFile: a\n---\n\nFile: b\n---"]
    assert text("selected") == ["File: a\n---"] and text("none") == [] and text("none", trees) == ["."]


def test_parts_of_a_file_map_are_the_map(spark):
    rows = [(f"s{n % 3}", f"d{n % 4}/f{n:02}.py", ("full", "codemap")[n % 2], n % 5 == 1) for n in range(40)] + [("s0", "d0/gone.py", "codemap", False), ("s0", "d0/blank.py", "codemap", False), (None, "d0/f00.py", "codemap", False)]
    entries = spark.createDataFrame(rows, "session_id string, path string, mode string, auto boolean")
    maps = spark.createDataFrame([(f"d{n % 4}/f{n:02}.py", f"File: {n}\n" + "x = 1\n" * n) for n in range(40)] + [("d0/blank.py", " \n")], "path string, text string")
    drawn = tree.of_sessions(entries)
    told = {}
    for r in drawn.orderBy("session_id", "place").collect():
        told[r["session_id"]] = told.get(r["session_id"], tree.HEAD) + "\n" + r["line"]
    trees = spark.createDataFrame(list(told.items()), "session_id string, tree string")
    for usage, lines, texts in (("auto", drawn, trees), ("selected", None, None), ("none", drawn, trees)):
        whole = {r["session_id"]: r["text"] for r in packaging.file_map(entries.where("session_id IS NOT NULL"), maps, usage, texts).collect()}
        pieces = sum(text.count("File: ") for text in whole.values()) + (drawn.count() if lines is not None else 0)
        for budget in (1, 60):
            parts = packaging.file_map_parts(entries, maps, usage, lines, budget).orderBy("session_id", "part").collect()
            joined = {}
            for r in parts:
                joined[r["session_id"]] = joined.get(r["session_id"], "") + r["text"]
            assert joined == whole
            assert all(r["section"] == "file_map" and r["part"] >= 0 for r in parts)
            # a part begins within the budget, and only its last piece may reach beyond it
            assert all(len(r["text"].encode()) / 4 <= budget + 70 for r in parts)
            assert len(parts) == pieces if budget == 1 else len(parts) < pieces
    assert packaging.file_map_parts(entries.limit(0), maps, trees=drawn.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packaging.file_map_parts(entries, maps, budget=0)


def test_profiles_replace_and_stay_apart(spark, tmp_path):
    files = spark.createDataFrame([("a", "x\n"), ("b", "y\n")], "path string, content string")
    rows = lambda p: selection.measured(spark.createDataFrame([("s", p, "full", [])], f"session_id string, path string, mode string, slices {selection.SLICES}"), files)
    folder = str(tmp_path / "p")
    for path, name in (("a", "one"), ("a", "two"), ("b", "one")):
        selection.save_profile(rows(path), folder, "s", name)
    held = {name: selection.load_profile(spark, folder, name, "t").select("session_id", "path").first() for name in ("one", "two")}
    assert {n: tuple(r) for n, r in held.items()} == {"one": ("t", "b"), "two": ("t", "a")}
    prompts = spark.createDataFrame([("s", "x"), ("t", "y")], "session_id string, prompt string")
    left, said = selection.cleared(rows("a"), prompts, "s")
    assert left.count() == 0 and [r["session_id"] for r in said.collect()] == ["t"]


def test_arguments_and_errors_of_tools(space, monkeypatch):
    for tool, bad in (
        ("file_search", {"pattern": ""}), ("file_search", {"pattern": "x", "nonsense": 1}), ("get_code_structure", {}), ("prompt", {"op": "set"}), ("file_actions", {"path": "x"}), ("git", {"op": "push"}),
        ("manage_selection", {}), ("read_file", {"path": "x", "limit": 0}), ("apply_edits", {"path": "x", "rewrite": "a", "expected_sha256": "short"}), ("apply_edits", {"path": "x", "edits": [{"search": "", "replace": ""}]}),
    ):
        assert space.call(tool, bad)["error"]["code"] == "invalid_request", tool
    assert space.call("git", {"op": "status"})["error"]["code"] == "not_a_repo"
    monkeypatch.setenv("PATH", "/nowhere")
    with pytest.raises(vcs.VcsError) as error:
        vcs.git_lines(space.spark, space.root, "status")
    assert error.value.code == "git_unavailable"
    assert space.call("nothing", {})["error"]["code"] == "unknown_tool"


def test_git_tool(space):
    git = lambda *args: subprocess.run(["git", "-C", space.root, "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)
    git("init", "-q"), git("add", "note.txt"), git("commit", "-qm", "first")
    (tools.Path(space.root) / "note.txt").write_text("one\nKey three\n")
    assert {f["path"] for f in space.call("git", {"op": "status"})["files"]} >= {"note.txt"}
    assert space.call("git", {"op": "diff", "detail": "files"})["diff"][0]["insertions"] == 1
    assert space.call("git", {"op": "log"})["commits"][0]["subject"] == "first"
    assert space.call("git", {"op": "blame", "path": "note.txt", "end_line": 1})["lines"][0]["content"] == "one"


def test_command_line(spark, space):
    asked = cli.parser().parse_args(["search", space.root, "--pattern", "Key", "--whole-word", "--max-results", "5"])
    assert len(cli.run(spark, asked)["matches"]) == 2
    assert cli.run(spark, cli.parser().parse_args(["index", space.root]))["files"] == 3
    assert cli.run(spark, cli.parser().parse_args(["tool", space.root, "read_file", '{"path": "note.txt", "limit": 1}']))["files"][0]["text"] == "one\n"
    assert set(policy.ARGUMENTS) == set(policy.TOOLS)
    assert cli.run(spark, cli.parser().parse_args(["config", space.root]))["profile"] == "full"


def test_search_ranks_what_was_committed_last(space):
    import os

    def git(*args):
        subprocess.run(["git", "-C", space.root, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, env={**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null"})

    for name in ("x1.md", "x2.md", "x3.md"):
        with open(f"{space.root}/{name}", "w") as out:
            out.write("needle here\n")
    before = [m["path"] for m in space.call("file_search", {"pattern": "needle", "mode": "content"})["matches"]]
    git("init", "-q")
    git("add", "x3.md")
    git("commit", "-qm", "third")
    after = [m["path"] for m in space.call("file_search", {"pattern": "needle", "mode": "content"})["matches"]]
    assert before == ["x1.md", "x2.md", "x3.md"] and after == ["x3.md", "x1.md", "x2.md"]


def test_other_roots_are_kept_and_closed(space, tmp_path):
    roots = [tmp_path / f"r{i}" for i in range(5)]
    for root in roots:
        root.mkdir()
        (root / "a.txt").write_text("alone\n")
        assert len(space.call("file_search", {"pattern": "alone", "root": str(root)})["matches"]) == 1
    assert [k.rsplit("/", 1)[-1] for k in space.others.held] == ["r1", "r2", "r3", "r4"]
    space.close()
    assert not space.others.held
    space.others = None
    assert space.call("file_search", {"pattern": "alone", "root": str(roots[0])})["error"]["code"] == "invalid_root"


def test_slices_keep_their_descriptions(space):
    space.call("manage_selection", {"op": "add", "slices": [{"path": "note.txt", "ranges": [{"start_line": 1, "end_line": 1, "description": "the start"}]}]})
    assert space.selected().first()["slices"][0]["description"] == "the start"


def test_answers_are_bounded_and_say_so(space, monkeypatch):
    space.call("manage_selection", {"op": "add", "paths": ["note.txt", "src/b.py"], "mode": "full"})
    monkeypatch.setattr(tools, "READ_CHARS", 5)
    got = space.call("manage_selection", {"op": "get", "view": "content"})
    assert [(r["path"], r["text"], r["omitted_chars"]) for r in got["selection"]] == [("note.txt", "one\nK", 7)] and got["limit_hit"] and got["omitted_total"] == 1
    monkeypatch.setattr(tools, "MOST_ROWS", 1)
    got = space.call("manage_selection", {"op": "get", "view": "files"})
    assert [r["path"] for r in got["selection"]] == ["note.txt"] and got["omitted_total"] == 1
    for tool, bad in (("git", {"op": "log", "count": 1001}), ("git", {"op": "blame", "path": "a", "start_line": 1, "end_line": 2001}), ("workspace_context", {"include": ["nothing"]})):
        assert space.call(tool, bad)["error"]["code"] == "invalid_request", tool


def test_parts_of_answers_that_are_asked_for(space):
    space.call("manage_selection", {"op": "add", "paths": ["note.txt"], "mode": "full"})
    space.call("prompt", {"op": "set", "text": "Do it."})
    text = open(space.call("workspace_context", {"op": "export", "include": ["user_instructions"]})["payload"]).read()
    assert "Do it." in text and "<file_contents>" not in text and "<file_map>" not in text
    short = space.call("apply_edits", {"path": "note.txt", "search": "one", "replace": "1", "verbose": False})
    assert short["status"] == "applied" and not {"diff", "post_context"} & set(short)


def test_tools_read_only_what_changed(space):
    """Declarations and contents outlive a session; an edit makes only its own file anew; old selections leave no table."""
    assert "Base" in space.call("get_code_structure", {"paths": ["src"]})["files"][1]["text"]
    first = space.declared.manifest()["number"]
    space.call("apply_edits", {"path": "src/b.py", "search": "Base", "replace": "Root"})
    assert "Root" in space.call("get_code_structure", {"paths": ["src"]})["files"][1]["text"]
    now = space.declared.manifest()
    assert now["number"] > first and space.declared.stamps().count() == 3
    later = tools.Workspace(space.spark, space.root)
    assert later.catalog.refresh() == {"added": 0, "changed": 0, "removed": 0}
    assert "Root" in later.call("get_code_structure", {"paths": ["src"]})["files"][1]["text"] and later.declared.manifest() == now
    for path in ("src/a.py", "src/b.py", "note.txt"):
        space.call("manage_selection", {"op": "add", "paths": [path]})
    assert len([p for p in (space.state / "tables").iterdir() if p.name.startswith("selection-")]) == 1
