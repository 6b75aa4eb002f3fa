"""Version-control records: parsers over tables of text lines, and the commands whose output they read."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import ordering

# The states of a status, in their order, and the cap on a file's patch lines.
STATES = ["staged", "unstaged", "untracked", "deleted", "renamed"]
PATCH_LINES = 300
UNIT = "\x1f"


class VcsError(RuntimeError):
    """A command that could not run. code: git_unavailable (no such program), not_a_repo, or git_error."""

    def __init__(self, code: str, message: str):
        super().__init__(f"git_failed: {code}: {message}")
        self.code = code


def git_lines(spark: SparkSession, repo: str, *args: str) -> DataFrame:
    """(line_no from 0, line): what a read-only git command prints for one repository."""
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace")
    except FileNotFoundError as error:
        raise VcsError("git_unavailable", str(error)) from error
    if done.returncode:
        said = done.stderr.strip()[:500]
        raise VcsError("not_a_repo" if "not a git repository" in said.lower() or "outside repository" in said.lower() else "git_error", said)
    return spark.createDataFrame(list(enumerate(done.stdout.splitlines())), "line_no int, line string")


def compare_args(spec: str) -> list[str]:
    """git diff arguments of a comparison: uncommitted, staged, unstaged, back:N, mergebase:X, main, trunk, or a revision."""
    fixed = {"uncommitted": ["HEAD"], "staged": ["--cached"], "unstaged": []}
    if spec in fixed:
        return fixed[spec]
    kind, _, value = spec.partition(":")
    if kind == "back" and value.isdigit():
        return [f"HEAD~{value}"]
    if kind == "mergebase" and value:
        return [f"{value}...HEAD"]
    if spec in ("main", "trunk"):
        return [f"{spec}...HEAD"]
    if spec.startswith("-"):
        raise ValueError(f"invalid_revision: {spec}")
    return [spec]


def status_entries(lines: DataFrame) -> DataFrame:
    """(path, state, orig_path) from porcelain v2 lines. An ordinary entry gives a row for each side that changed."""
    cut = F.split("line", " ")
    xy = F.get(cut, 1)
    ordinary = F.array_join(F.slice(cut, F.lit(9), F.greatest(F.size(cut) - 8, F.lit(0))), " ")
    side = lambda at, name: F.when(~F.substring(xy, at, 1).isin(".", " "), F.struct(ordinary.alias("path"), F.when(F.substring(xy, at, 1) == "D", F.lit("deleted")).otherwise(F.lit(name)).alias("state"), F.lit(None).cast("string").alias("orig_path")))
    halves = F.split("line", "\t")
    renamed = F.struct(F.get(F.split(F.get(halves, 0), " "), 9).alias("path"), F.lit("renamed").alias("state"), F.get(halves, 1).alias("orig_path"))
    unknown = F.struct(F.substring("line", 3, 1 << 20).alias("path"), F.lit("untracked").alias("state"), F.lit(None).cast("string").alias("orig_path"))
    kind = F.substring("line", 1, 2)
    found = F.when(kind == "1 ", F.array(side(1, "staged"), side(2, "unstaged"))).when(kind == "2 ", F.array(renamed)).when(kind == "? ", F.array(unknown))
    return lines.select(F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")).select("e.*")


def branch_facts(lines: DataFrame) -> DataFrame:
    """One row: branch, upstream, ahead, behind from the header lines of a status."""
    value = lambda key: F.max(F.regexp_extract("line", f"^# branch\\.{key} (.*)$", 1))
    rows = lines.agg(value("head").alias("branch"), F.nullif(value("upstream"), F.lit("")).alias("upstream"), value("ab").alias("_ab"))
    number = lambda pattern: F.regexp_extract("_ab", pattern, 1).try_cast("int")
    return rows.select("branch", "upstream", F.coalesce(number("\\+(\\d+)"), F.lit(0)).alias("ahead"), F.coalesce(number("-(\\d+)"), F.lit(0)).alias("behind"))


def status_totals(entries: DataFrame) -> DataFrame:
    """(state, count) with a row for every state."""
    spark = entries.sparkSession
    states = spark.range(1).select(F.explode(F.array(*map(F.lit, STATES))).alias("state"))
    counts = entries.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return states.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def diff_files(numstat: DataFrame, name_status: DataFrame) -> DataFrame:
    """(path, old_path, status, insertions, deletions, binary): name-status lines with the numbers of their path, else 0."""
    cut = F.split("line", "\t")
    number = lambda k: F.coalesce(F.get(cut, k).try_cast("long"), F.lit(0))
    stats = numstat.where(F.size(cut) >= 3).select(F.get(cut, 2).alias("path"), number(0).alias("insertions"), number(1).alias("deletions"), ((F.get(cut, 0) == "-") | (F.get(cut, 1) == "-")).alias("binary"))
    names = name_status.where("line <> ''").select(F.coalesce(F.get(cut, 2), F.get(cut, 1)).alias("path"), F.when(F.get(cut, 2).isNotNull(), F.get(cut, 1)).alias("old_path"), F.substring(F.get(cut, 0), 1, 1).alias("status"))
    zero = F.lit(0).cast("long")
    return names.join(stats, "path", "left").select("path", "old_path", "status", F.coalesce("insertions", zero).alias("insertions"), F.coalesce("deletions", zero).alias("deletions"), F.coalesce("binary", F.lit(False)).alias("binary"))


def diff_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("insertions"), F.lit(0)).alias("insertions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"))


def patch_hunks(lines: DataFrame, max_lines: int | None = PATCH_LINES, group: str | None = None) -> DataFrame:
    """(path, hunk_no, header, old_start, new_start, patch, omitted_lines) from unified patches.

    lines: line_no, line and, where there are many patches, `group` that tells them apart. A file shows max_lines
    of its hunks' lines; omitted_lines counts the rest of a hunk. A line learns its file and hunk from what is carried
    over ranges of lines, so that no patch meets in one task; a hunk's row holds at most max_lines lines.
    """
    keys = [group] if group else []
    named = F.regexp_extract("line", "^diff --git a/(.+) b/(.+)$", 2)
    marks = {
        "_f": F.when(F.col("line").startswith("diff --git "), F.struct(*keys, "line_no", named.alias("path"))),
        "_h": F.when(F.col("line").startswith("@@ "), F.struct(*keys, "line_no", F.col("_pos").alias("pos"))),
    }
    rows = ordering.running(lines.select(*keys, "line_no", "line"), [*keys, "line_no"], {"_pos": F.lit(1).cast("long")}, marks)
    for key in keys:
        rows = rows.where(F.col(key).eqNullSafe(F.col(f"_f.{key}")) & F.col(key).eqNullSafe(F.col(f"_h.{key}")))
    rows = rows.where("_h.line_no > _f.line_no").select(*keys, "line_no", "line", "_f.path", F.col("_f.line_no").alias("_file"), F.col("_h.line_no").alias("_hunk"), (F.col("_pos") - F.col("_h.pos")).alias("_k"))
    held = F.struct("line_no", "line") if max_lines is None else F.when(F.col("_k") < max_lines, F.struct("line_no", "line"))
    hunks = rows.groupBy(*keys, "path", "_file", "_hunk").agg(F.min_by("line", "line_no").alias("header"), F.array_sort(F.collect_list(held))["line"].alias("_lines"), F.count(F.lit(1)).alias("_n"))
    of_file = Window.partitionBy(*keys, "_file").orderBy("_hunk")
    hunks = hunks.withColumn("hunk_no", F.row_number().over(of_file)).withColumn("_before", F.coalesce(F.sum("_n").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shown = F.col("_n") if max_lines is None else F.least(F.col("_n"), F.greatest(F.lit(max_lines) - F.col("_before"), F.lit(0)))
    hunks = hunks.withColumn("patch", F.array_join(F.slice("_lines", F.lit(1), shown.cast("int")), "\n")).withColumn("omitted_lines", F.col("_n") - shown)
    at = lambda k: F.regexp_extract("header", "^@@ -(\\d+)(?:,\\d+)? \\+(\\d+)", k).try_cast("int")
    return hunks.select(*keys, "path", F.col("hunk_no").cast("int"), "header", F.coalesce(at(1), F.lit(0)).alias("old_start"), F.coalesce(at(2), F.lit(0)).alias("new_start"), "patch", "omitted_lines")


def log_entries(lines: DataFrame) -> DataFrame:
    """(sha, short_sha, author, date_iso, subject) from lines whose fields are parted by the unit separator."""
    cut = F.split("line", UNIT)
    return lines.where(F.contains("line", F.lit(UNIT))).select(*[F.get(cut, k).alias(n) for k, n in enumerate(("sha", "short_sha", "author", "date_iso", "subject"))])


def blame_lines(lines: DataFrame, group: str | None = None) -> DataFrame:
    """(line, sha_short, author, date_iso, content) from porcelain blame; a commit's facts stand at its first line."""
    keys = [group] if group else []
    head = F.regexp_extract("line", "^([0-9a-f]{40}) \\d+ (\\d+)", 1)
    at = F.regexp_extract("line", "^([0-9a-f]{40}) \\d+ (\\d+)", 2).try_cast("int")
    rows = ordering.running(lines.select(*keys, "line_no", "line"), [*keys, "line_no"], {}, {"_head": F.when(head != "", F.struct(*keys, head.alias("sha"), at.alias("at")))})
    for key in keys:
        rows = rows.where(F.col(key).eqNullSafe(F.col(f"_head.{key}")))
    rows = rows.select(*keys, "line", F.col("_head.sha").alias("_sha"), F.col("_head.at").alias("_at"))
    value = lambda key: F.max(F.when(F.col("line").startswith(f"{key} "), F.substring("line", len(key) + 2, 1 << 20)))
    facts = rows.groupBy(*keys, "_sha").agg(value("author").alias("author"), value("author-time").try_cast("long").alias("_time"))
    text = rows.where(F.col("line").startswith("\t")).select(*keys, "_sha", F.col("_at").alias("line_no"), F.substring("line", 2, 1 << 20).alias("content"))
    iso = F.date_format(F.timestamp_seconds("_time"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return text.join(facts, [*keys, "_sha"], "left").select(*keys, F.col("line_no").alias("line"), F.substring("_sha", 1, 8).alias("sha_short"), "author", iso.alias("date_iso"), "content")


def head_lines(text, most: int):
    """The first lines of a text, with a note on how many follow."""
    parts = F.split(text, "\n")
    more = F.size(parts) - most
    return F.when(more > 0, F.concat(F.array_join(F.slice(parts, 1, most), "\n"), F.lit("\n... ("), more.cast("string"), F.lit(" more lines omitted)"))).otherwise(text)


def history(spark: SparkSession, repo: str, commits: int = 200) -> DataFrame:
    """(path, pos): the files of the last commits, latest first."""
    lines = git_lines(spark, repo, "log", f"-{commits}", "--name-only", "--pretty=format:")
    return lines.where("line <> ''").select(F.col("line").alias("path"), F.col("line_no").alias("pos"))


def diff(spark: SparkSession, repo: str, spec: str = "uncommitted", detail: str = "files", max_lines: int = PATCH_LINES) -> DataFrame:
    """A comparison of one repository as `summary` (totals), `files`, `patches` (hunks, capped) or `full` (all hunks)."""
    args = compare_args(spec)
    safe = ["diff", "--no-ext-diff", "--no-color"]
    if detail in ("patches", "full"):
        return patch_hunks(git_lines(spark, repo, *safe, *args), max_lines if detail == "patches" else None)
    found = diff_files(git_lines(spark, repo, *safe, "--numstat", *args), git_lines(spark, repo, *safe, "--name-status", *args))
    if detail == "files":
        return found
    if detail == "summary":
        return diff_totals(found)
    raise ValueError(f"unknown detail: {detail}")


def show(spark: SparkSession, repo: str, revision: str = "HEAD", detail: str = "files") -> tuple[DataFrame, DataFrame]:
    """A commit's record, and its changes against its first parent."""
    if revision.startswith("-"):
        raise ValueError(f"invalid_revision: {revision}")
    meta = log_entries(git_lines(spark, repo, "log", "-1", "--pretty=format:%H%x1f%h%x1f%an%x1f%aI%x1f%s", revision))
    return meta, diff(spark, repo, f"{revision}^!", detail)
