"""The tools of a workspace by name, with checked JSON arguments: each is a few operators over its files as a DataFrame.

What a tool hands over is bounded by its caps (results, characters, tokens); the state of a workspace, its selection and
prompt, lies in tables beside it, of which a small JSON file names the current ones.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime
from pathlib import Path

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.operators import budget, edits, packaging, read, search, selection, structure, tree
from lodestone.plans import config, policy
from lodestone.sources import corpus, stores, vcs
from lodestone.sources.versions import Versioned, opened

READ_CHARS, BLAME_LINES, LOG_COMMITS = 50_000, 200, 20
#: Rows of an answer at most, and of one whose rows hold texts.
MOST_ROWS, MOST_TEXTS = 2000, 200


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _some(df: DataFrame, order: list[str], name: str, text: str | None = None) -> dict:
    """The first rows by the order as far as the caps go, and how many are left out. A text is cut after READ_CHARS
    characters, all texts together have no more, and omitted_chars says what a text lost."""
    if text is None:
        kept = _rows(df.orderBy(*order).limit(MOST_ROWS))
    else:
        cut = df.withColumns({"omitted_chars": F.greatest(F.char_length(text) - READ_CHARS, F.lit(0)), text: F.substring(text, 1, READ_CHARS)}).withColumn("_chars", F.char_length(text))
        kept = _rows(budget.choose(cut, order, "_chars", READ_CHARS, MOST_TEXTS, first_free=True).orderBy("position").drop("position", "_chars"))
    left = df.count() - len(kept)
    return {name: kept, "limit_hit": left > 0 or any(r.get("omitted_chars") for r in kept), "omitted_total": left}


class Workspace:
    """One folder with its settings and one session's selection and prompt."""

    def __init__(self, spark: SparkSession, root: str, settings: dict | None = None, session: str = "default"):
        self.spark, self.root = spark, policy.valid_root(root)
        self.settings = settings or config.load(self.root)
        self.session = selection.session_key(session, self.settings["selection"]["scope"])
        self.state = Path(self.root) / ".lodestone"
        own = self.settings
        self.tables = self._shared()
        self.catalog = corpus.Catalog(spark, self.root, f"{self.tables}/files", own["ignore"]["extra"], own["ignore"]["ios_preset"], own["caps"]["file_size_bytes"])
        self.declared = Versioned(spark, f"{self.tables}/symbols", structure.SYMBOL)
        self.known = False
        more = self.settings["dynamic_roots"]
        self.others = policy.Roots(lambda found: Workspace(spark, found, session=self.session), most=more["max"], close=Workspace.close) if more["enabled"] else None

    def close(self) -> None:
        """Lets go of what is kept of the files, here and in the other roots that were opened from here."""
        self.catalog.drop()
        while self.others is not None and self.others.held:
            self.others.held.popitem()[1].close()

    def call(self, tool: str, arguments: dict) -> dict:
        """What the tool gives, or an error with a code: a tool that is off, arguments that break a rule, a failed command."""
        refused = policy.refusal(tool, self.settings)
        if refused:
            return {"error": refused}
        try:
            asked = policy.checked(tool, arguments)
            if "root" in asked and policy.valid_root(asked["root"]) != self.root:
                if self.others is None:
                    raise ValueError("invalid_root: other roots are turned off")
                return self.others.get(asked["root"]).call(tool, {k: v for k, v in asked.items() if k != "root"})
            return getattr(self, f"_{tool}")({k: v for k, v in asked.items() if k != "root"})
        except vcs.VcsError as error:
            return {"error": {"code": error.code, "message": str(error)}}
        except ValueError as error:
            return {"error": {"code": str(error).split(":")[0], "message": str(error)}}

    def _shared(self) -> str:
        """Where the workspace's tables lie: below its state where one machine runs all, else in the warehouse."""
        if self.spark.sparkContext.master.startswith("local"):
            return f"file://{self.state}/tables"
        return f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestone/{hashlib.sha256(self.root.encode()).hexdigest()[:16]}"

    def files(self) -> DataFrame:
        """The scanned folder with contents as text; binary files keep their flag and no text."""
        return self._texts(self.catalog.files())

    def _texts(self, found: DataFrame) -> DataFrame:
        return found.withColumn("content", F.when(F.col("is_binary"), F.lit("")).otherwise(F.col("content").cast("string")))

    def symbols(self) -> DataFrame:
        """The declarations of all files, from a table of which only the parts of changed files are worked out anew."""
        if not self.catalog.looked or not self.known:
            structure.keep(self._texts(self.catalog.stamped()), self.declared)
            self.known = True
        return self.declared.read()

    def changed(self, paths: list[str]) -> None:
        """The catalog is looked at again, and of it and of what is derived from it only what these paths hold is made anew."""
        self.catalog.drop()
        self.known = False

    # state

    def _held(self) -> dict:
        return stores.read_json(self.state / f"{self.session}.json") or {}

    def _keep(self, **facts) -> None:
        stores.write_json(self.state / f"{self.session}.json", self._held() | facts)

    def selected(self) -> DataFrame:
        folder = self._held().get("selection")
        return self.spark.read.schema(selection.SCHEMA).parquet(folder) if folder else self.spark.createDataFrame([], selection.SCHEMA)

    def _select(self, rows: DataFrame) -> None:
        before, folder = self._held().get("selection"), f"{self.tables}/selection-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self._keep(selection=folder)
        if before:  # no file names it any more
            system, base = opened(before)
            system.delete_dir(base)

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        """The selection as it is now, with what closure adds, and the codemaps of all files."""
        files = self.files()
        found = self.symbols()
        maps = structure.codemaps(found)
        now = selection.invalidate(self.selected(), files)
        if not self.settings["selection"]["auto_codemaps"]:
            return now.withColumn("auto", F.lit(False)), maps
        auto = selection.closure(now, structure.references(found), structure.type_index(found))
        return selection.with_auto(now, auto, files, maps), maps

    # tools

    def _file_search(self, a: dict) -> dict:
        narrow = a.get("filters", {})
        kept, caps = search.answer(
            self.files(), a["pattern"], mode=a.get("mode", "auto"), regex=a.get("regex", False), whole_word=a.get("whole_word", False), paths=narrow.get("paths", []), extensions=narrow.get("extensions", []),
            exclude=narrow.get("exclude", []), recent=self._recent(), context_lines=a.get("context_lines", 0), context_paths=a.get("contextPaths", []), max_results=a.get("max_results", 50), max_chars=self.settings["caps"]["search_chars"],
        )
        return {"matches": _rows(kept.orderBy("rank"))} | _rows(caps)[0]

    def _recent(self) -> DataFrame | None:
        """The files of the last commits by rank, from 0 for the latest; none where the root is in no repository."""
        try:
            return search.recency(vcs.history(self.spark, self.root), top=search.RECENT)
        except vcs.VcsError:
            return None

    def _read_file(self, a: dict) -> dict:
        paths = [P.normalised(p) for p in a.get("paths", [a.get("path")])]
        rows = self.files().where(F.col("path").isin(paths))
        cut = read.slice_lines(rows, a.get("start_line", 1), a.get("limit")).withColumn("error", read.refusal())
        asked = self.spark.createDataFrame(list(enumerate(paths)), "request_idx int, path string")
        batch = read.read_batch(asked, cut.select("path", F.when(F.col("error").isNull(), F.col("slice")).alias("content")), READ_CHARS)
        facts = cut.select("path", "total_lines", "first_line", "last_line", "error")
        found = _rows(batch.join(facts, "path", "left").orderBy("request_idx"))
        omitted = sum(r["omitted"] or 0 for r in found)
        return {"files": found, "limit_hit": omitted > 0, "omitted_total": omitted}

    def _get_file_tree(self, a: dict) -> dict:
        below = self.files().where(P.under("path", [a["path"]] if "path" in a else [])).select("path")
        chosen = self.selected()
        marked = tree.anchors(tree.rollup(below), chosen.where("mode <> 'codemap'").select("path"), chosen.where("mode = 'codemap'").select("path"))
        return tree.render(marked, a.get("mode", "auto"), a.get("max_tokens", self.settings["caps"]["tree_tokens"]), a.get("max_depth"), have_selection=not chosen.isEmpty())

    def _get_code_structure(self, a: dict) -> dict:
        maps = structure.codemaps(self.symbols())
        wanted = [r["path"] for r in self.selected().select("path").collect()] if a.get("scope") == "selected" else a["paths"]
        if not wanted:
            return {"files": [], "limit_hit": False, "omitted_total": 0}
        kept = _rows(structure.structures(maps, wanted, a.get("max_results", structure.MAX_FILES), self.settings["caps"]["structure_tokens"]).orderBy("position"))
        left = maps.where(P.under("path", wanted)).count() - len(kept)
        return {"files": kept, "limit_hit": left > 0, "omitted_total": left}

    def _entries(self, a: dict) -> DataFrame:
        """The paths and slices of a request as entries of the session; a directory stands for its files."""
        mode = {"codemap_only": "codemap"}.get(a.get("mode", "full"), a.get("mode", "full"))
        named = self.files().where(P.under("path", a["paths"])).select("path") if a.get("paths") else self.files().limit(0).select("path")
        rows = named.select(F.lit(self.session).alias("session_id"), "path", F.lit(mode).alias("mode"), F.array().cast(selection.SLICES).alias("slices"))
        cut = [(self.session, P.normalised(s["path"]), "slices", [(r["start_line"], r.get("end_line", r["start_line"]), r.get("description")) for r in s.get("ranges", [])]) for s in a.get("slices", [])]
        return rows.unionByName(self.spark.createDataFrame(cut, rows.schema)) if cut else rows

    def _manage_selection(self, a: dict) -> dict:
        op, held, files = a["op"], self.selected(), self.files()
        profiles = f"{self.tables}/profiles"
        if op == "list_profiles":
            system, base = opened(profiles)
            there = system.get_file_info(base).type != pyarrow.fs.FileType.NotFound
            return {"profiles": sorted(r["profile"] for r in selection.profiles(self.spark, profiles).collect()) if there else []}
        if op in ("save_profile", "load_profile") and "name" not in a:
            raise ValueError("invalid_request: a name for the profile")
        if op == "save_profile":
            selection.save_profile(held, profiles, self.session, a["name"])
        elif op == "load_profile":
            self._select(selection.invalidate(selection.load_profile(self.spark, profiles, a["name"], self.session), files))
        elif op == "clear":
            self._keep(selection=None, prompt="")
        elif op != "get":
            entries = self._entries(a)
            unknown = [p for p in a.get("paths", []) if files.where(P.under("path", [p])).isEmpty()] if a.get("strict") else []
            if unknown:
                return {"error": {"code": "not_found", "paths": unknown}}
            maps = structure.codemaps(self.symbols())
            if op in ("promote", "demote"):
                auto, _ = self.snapshot()
                self._select(selection.set_mode(held, entries, "full" if op == "promote" else "codemap", auto))
            else:
                self._select({"add": selection.add, "set": selection.replace}[op](held, entries, files, maps) if op != "remove" else selection.remove(held, entries, files))
        shown, maps = self.snapshot()
        kind = a.get("view", "summary")
        found = selection.view(shown, kind, files, maps)
        return {"selection": _rows(found)} if kind == "summary" else _some(found, ["path"], "selection", None if kind == "files" else "text")

    def _prompt(self, a: dict) -> dict:
        now = self._held().get("prompt", "")
        text = {"get": now, "clear": "", "set": a.get("text", ""), "append": now + a.get("text", "")}[a["op"]]
        if text != now:
            self._keep(prompt=text)
        return {"prompt": text}

    def _workspace_context(self, a: dict) -> dict:
        """A payload of the selection by a preset; `export` writes it with its receipt."""
        own, files, prompt = self.settings, self.files(), self._held().get("prompt", "")
        name = self.spark.range(1).select(packaging.preset(F.lit(a.get("preset")).cast("string"), F.lit(a.get("response_type")).cast("string"), F.lit(prompt), list(own["presets"])).alias("p")).first()["p"]
        preset = own["presets"][name]
        shown, maps = self.snapshot()
        section = lambda what, text: self.spark.createDataFrame([(self.session, what, text)], "session_id string, section string, text string")
        trees = None
        if preset["include_tree"]:
            drawn = self._get_file_tree({"mode": preset["tree_mode"]}).get("tree", "")
            trees = self.spark.createDataFrame([(self.session, drawn)], "session_id string, tree string")
        sections = packaging.file_map(shown, maps, preset["codemap_usage"], trees).unionByName(section("user_instructions", prompt)).unionByName(section("meta_prompts", packaging.meta_prompts(preset["meta_prompts"])))
        if preset["include_files"]:
            sections = sections.unionByName(packaging.joined_blocks(packaging.file_blocks(shown, files)).select("session_id", F.lit("file_contents").alias("section"), "text"))
        if "git_diff_text" in a or preset["git_inclusion"] != "none":
            patches = lambda: "\n".join(r["patch"] for r in vcs.diff(self.spark, self.root, a.get("git_compare", "uncommitted"), "patches").collect())
            sections = sections.unionByName(section("git_diff", a["git_diff_text"] if "git_diff_text" in a else patches()))
        if "include" in a:
            sections = sections.where(F.col("section").isin(a["include"]))
        made = packaging.payload(sections, own["packager"]["section_order"], own["packager"]["duplicate_instructions_at_top"])
        costs = packaging.breakdown(sections, shown, made, self.spark.createDataFrame([(self.session, prompt)], "session_id string, prompt string"))
        if a.get("op", "snapshot") == "snapshot":
            return {"preset": name, "tokens": _rows(costs), "selection": _rows(selection.view(shown, "files"))}
        now = datetime.now(UTC)
        told = packaging.receipt(shown, made, costs, name, own["budgets"]["plan"], now.isoformat(timespec="milliseconds").replace("+00:00", "Z"))
        text, receipt = stores.export_payload(made, told, self.session, str(self.state / "exports"), now)
        return {"preset": name, "payload": str(text), "receipt": str(receipt), "tokens": _rows(costs)}

    def _apply_edits(self, a: dict) -> dict:
        path = P.normalised(a["path"])
        edits.inside(self.root, path)
        listed = self.catalog.files().where(F.col("path") == path).select("path", "abs_path", "size", "mtime_ms")
        files = self._texts(corpus.with_contents(listed, self.root, self.settings["caps"]["file_size_bytes"], whole=True))  # as it is now
        if "rewrite" in a:
            plan = edits.rewritten(files, self.spark.createDataFrame([(path, a["rewrite"])], "path string, rewrite string"), create=a.get("on_missing") == "create")
        else:
            asked = a.get("edits") or [{"search": a["search"], "replace": a["replace"], "all": a.get("all", False)}]
            rows = [(path, k, e["search"], e["replace"], e.get("all", False)) for k, e in enumerate(asked)]
            plan = edits.planned(files, self.spark.createDataFrame(rows, "path string, edit_index int, search string, replace string, `all` boolean"))
        expected = {path: a["expected_sha256"]} if "expected_sha256" in a else None
        done = edits.commit(plan, self.root, expected, a.get("dry_run", False), self.changed)[0]
        return done if a.get("verbose", True) else {k: v for k, v in done.items() if k not in ("diff", "post_context")}

    def _file_actions(self, a: dict) -> dict:
        done = edits.file_action(self.root, a.get("action", a.get("op")), a["path"], a.get("content"), a.get("new_path", a.get("destination")), a.get("if_exists") == "overwrite", a.get("expected_sha256"))
        if "error" not in done:
            self.changed([a["path"]])
        return done

    def _differences(self, rows: DataFrame) -> dict:
        """A summary, files or hunks, as far as the caps go."""
        if "patch" in rows.columns:
            return _some(rows, ["path", "hunk_no"], "diff", "patch")
        return _some(rows, ["path"], "diff") if "path" in rows.columns else {"diff": _rows(rows)}

    def _git(self, a: dict) -> dict:
        op, lines = a["op"], lambda *args: vcs.git_lines(self.spark, self.root, *args)
        if op == "status":
            said = lines("status", "--porcelain=v2", "--branch")
            return {"branch": _rows(vcs.branch_facts(said))[0]} | _some(vcs.status_entries(said), ["path", "state"], "files")
        if op == "diff":
            return self._differences(vcs.diff(self.spark, self.root, a.get("compare", "uncommitted"), a.get("detail", "summary"), self.settings["caps"]["git_patch_lines"]))
        if op == "show":
            meta, rows = vcs.show(self.spark, self.root, a.get("revspec", "HEAD"), a.get("detail", "summary"))
            return {"commit": _rows(meta)[0]} | self._differences(rows)
        below = ["--", a["path"]] if "path" in a else []
        if op == "log":
            return {"commits": _rows(vcs.log_entries(lines("log", f"-{a.get('count', LOG_COMMITS)}", "--pretty=format:%H%x1f%h%x1f%an%x1f%aI%x1f%s", *below)))}
        first = a.get("start_line", 1)
        return {"lines": _rows(vcs.blame_lines(lines("blame", "--porcelain", f"-L{first},{a.get('end_line', first + BLAME_LINES - 1)}", *below)).orderBy("line"))}
