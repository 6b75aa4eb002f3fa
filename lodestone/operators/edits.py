"""Guarded text edits, planned as DataFrame operations: find, check, apply; then commit file by file.

An edit (path, edit_index, search, replace, all) is tried literally, then with its escapes decoded, then line by
line with fuzzy matching. A file's edits are applied together or not at all.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from lodestone.functions import text as T

# The Dice score that a line must reach, by the length of what is looked for.
THRESHOLDS = [(4, 0.25), (7, 0.35), (12, 0.5), (20, 0.65), (40, 0.7)]
LONG_THRESHOLD = 0.8
ERROR = "struct<code:string,message:string,lines:array<int>>"


def decoded(text: Column | str) -> Column:
    r"""\n \t \r \" and \\ as the characters they stand for; other escapes stay. Doubled backslashes are set aside first."""
    t = F.replace(T.col(text), F.lit("\\\\"), F.lit("\u0000"))
    for escape, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"')):
        t = F.replace(t, F.lit(escape), F.lit(char))
    return F.replace(t, F.lit("\u0000"), F.lit("\\"))


def threshold(length: Column) -> Column:
    found = F.lit(LONG_THRESHOLD)
    for most, score in reversed(THRESHOLDS):
        found = F.when(length <= most, F.lit(score)).otherwise(found)
    return found


def offsets(text: Column, phrase: Column) -> Column:
    """Where a phrase stands without overlap, in code points from 0."""
    parts = F.split(text, F.concat(F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    ends = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("o")),
        lambda s, p: F.struct((s["at"] + F.char_length(p) + F.char_length(phrase)).alias("at"), F.concat(s["o"], F.array(s["at"] + F.char_length(p))).alias("o")), lambda s: s["o"],
    )
    return F.when((F.char_length(phrase) == 0) | ~F.contains(text, phrase), F.array().cast("array<int>")).otherwise(ends)


def line_of(text: Column, offset: Column) -> Column:
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def _indent(line: Column) -> Column:
    return F.regexp_extract(line, "^[ \\t]*", 0)


def reanchored(replacement: Column, from_line: Column, to_line: Column) -> Column:
    """The replacement's lines moved from the indentation of the line that was looked for to that of the line found."""
    a, b = _indent(from_line), _indent(to_line)
    lines = F.split(replacement, "\n")
    deeper, shallower = F.substring(b, F.char_length(a) + 1, F.lit(1 << 20)), F.substring(a, F.char_length(b) + 1, F.lit(1 << 20))
    base = _indent(F.get(lines, 0))
    add = F.transform(lines, lambda x: F.when(x == "", x).otherwise(F.concat(deeper, x)))
    cut = F.transform(lines, lambda x: F.when(F.startswith(x, shallower), F.substring(x, F.char_length(shallower) + 1, F.lit(1 << 30))).otherwise(x))
    swap = F.transform(lines, lambda x: F.when(x == "", x).when(F.startswith(x, base), F.concat(b, F.substring(x, F.char_length(base) + 1, F.lit(1 << 30)))).otherwise(F.concat(b, F.ltrim(x))))
    return F.when(a == b, replacement).otherwise(F.array_join(F.when(F.startswith(b, a), add).when(F.startswith(a, b), cut).otherwise(swap), "\n"))


def resolved(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, edit_index, spans array<struct<start,end,replacement>>, matched_by, dice, error) for each edit."""
    return _with_content(files, edits).drop("content")


_NEAR = types.ArrayType(types.StructType([types.StructField("closest", types.IntegerType()), types.StructField("at", types.ArrayType(types.IntegerType())), types.StructField("dice", types.ArrayType(types.DoubleType()))]))


@F.arrow_udf(_NEAR)
def _near_lines(lines: pa.Array, wanted: pa.Array) -> pa.Array:
    """For each wanted (line, least score) of a file the place (from 1) of the line with the highest score, and places (from
    0) and scores of all that reach the least or are equal; null for a null one."""
    found = []
    for own, asked in zip(lines, wanted, strict=True):
        wants = asked.as_py() or []
        held = (own.as_py() or []) if any(wants) else []
        # an index is worth its making only where more than one line is looked for
        index = Bigrams(held) if sum(map(bool, wants)) > 1 else None
        row = []
        for want in wants:
            if want is None:
                row.append(None)
                continue
            scores = index.dice(want["line"]) if index else dice_of_lines(held, want["line"])
            at = np.flatnonzero((scores >= want["least"]) | (scores == 1.0))
            row.append({"closest": int(scores.argmax()) + 1 if len(scores) else None, "at": at.tolist(), "dice": scores[at].tolist()})
        found.append(row)
    return pa.array(found, pa.list_(pa.struct([("closest", pa.int32()), ("at", pa.list_(pa.int32())), ("dice", pa.list_(pa.float64()))])))


def dice_of_lines(lines: list[str], line: str) -> np.ndarray:
    """multiset_dice of one line with each of the lines, in one pass over them."""
    n = len(line)
    if n < 2:
        return np.array([float(x == line) for x in lines])
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join([line, *lines]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    pairs = points[:-1] << 21 | points[1:]
    grams, times = np.unique(pairs[: n - 1], return_counts=True)
    pairs = pairs[n:]
    place = np.minimum(np.searchsorted(grams, pairs), len(grams) - 1)
    at = np.flatnonzero(grams[place] == pairs)
    ends = np.cumsum(lengths)
    of = np.searchsorted(ends, at, side="right")
    inside = at + 1 < ends[of]  # a line's last character begins no pair
    cells, counts = np.unique(of[inside] * len(grams) + place[at[inside]], return_counts=True)
    shared = np.bincount(cells // len(grams), np.minimum(counts, times[cells % len(grams)]), len(lines))
    return np.where(lengths < 2, 0.0, shared * 2.0 / np.maximum(n - 1 + lengths - 1, 1))


class Bigrams:
    """The lines of a file by their bigrams: for each bigram the lines that hold it, and how often.

    A line is scored by adding up what it shares with the one looked for over the latter's bigrams; lines that share none
    are never looked at.
    """

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.lengths = np.array([len(x) for x in lines], np.int64)
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum(self.lengths)
        inside = np.ones(len(points), bool)
        inside[ends[self.lengths > 0] - 1] = False  # a line's last character begins no pair
        at = np.flatnonzero(inside)
        self.grams, number = np.unique(points[at] << 21 | points[at + 1], return_inverse=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        of = np.searchsorted(ends, at, side="right")
        held, self.counts = np.unique(number.astype(np.int64) << 32 | of, return_counts=True)
        self.held = held & 0xFFFFFFFF
        self.starts = np.searchsorted(held >> 32, np.arange(len(self.grams) + 1))

    def dice(self, line: str) -> np.ndarray:
        """multiset_dice of the line with each of the lines."""
        n = len(line)
        if n < 2:
            return np.array([float(x == line) for x in self.lines])
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        grams, times = np.unique(points[:-1] << 21 | points[1:], return_counts=True)
        place = np.searchsorted(self.grams, grams)
        known = np.flatnonzero(place < len(self.grams))
        known = known[self.grams[place[known]] == grams[known]]
        shared = np.zeros(len(self.lines))
        for k in known.tolist():
            part = slice(self.starts[place[k]], self.starts[place[k] + 1])
            shared[self.held[part]] += np.minimum(self.counts[part], times[k])
        return np.where(self.lengths < 2, 0.0, shared * 2.0 / np.maximum(n - 1 + self.lengths - 1, 1))


def _with_content(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits meet their file's content once, gathered by path; each then goes on with it where it is."""
    lf = lambda c: F.regexp_replace(c, "\r\n?", "\n")
    one = F.struct("edit_index", F.col("search").isNull().alias("unset"), lf(F.coalesce("search", F.lit(""))).alias("s"), lf(F.coalesce("replace", F.lit(""))).alias("r"), F.coalesce("all", F.lit(False)).alias("all"))
    asked = edits.groupBy("path").agg(F.collect_list(one).alias("_edits"))
    rows = asked.join(files.select("path", "content"), "path", "left")
    rows = rows.select("path", "content", F.col("content").isNull().alias("_none"), lf(F.coalesce("content", F.lit(""))).alias("t"), "_edits")
    # fuzzy: lines of the selector without blank ones, lines of the file as they are
    first = lambda s: F.get(F.filter(F.transform(F.split(s, "\n"), T.normalised_line), lambda x: x != ""), 0)
    held = lambda e: F.contains(F.col("t"), e["s"]) | (F.contains(e["s"], F.lit("\\")) & F.contains(F.col("t"), decoded(e["s"])))
    line = lambda e: F.when(~held(e), first(e["s"]))
    rows = rows.withColumn("_first", F.transform("_edits", line))
    some = F.exists("_first", lambda x: x.isNotNull())
    rows = rows.withColumn("_lines", F.when(some, T.lines("t")).otherwise(F.array().cast("array<string>"))).withColumn("_norm", F.transform("_lines", T.normalised_line))
    wanted = F.when(some, F.transform("_first", lambda x: F.when(x.isNotNull(), F.struct(x.alias("line"), threshold(F.char_length(x)).alias("least")))))
    rows = rows.withColumn("_near", _near_lines("_norm", wanted))
    rows = rows.withColumn("_e", F.explode(F.arrays_zip("_edits", "_near"))).select("path", "content", "_none", "t", "_lines", "_norm", F.col("_e._edits.*"), F.col("_e._near").alias("_near"))
    rows = rows.withColumn("_ds", decoded("s")).withColumn("_dr", decoded("r"))
    rows = rows.withColumn("_lit", offsets(F.col("t"), F.col("s")))
    rows = rows.withColumn("_esc", F.when((F.size("_lit") == 0) & F.contains("s", F.lit("\\")), offsets(F.col("t"), F.col("_ds"))).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_raw", F.filter(F.split("s", "\n"), lambda x: T.normalised_line(x) != "")).withColumn("_sel", F.transform("_raw", T.normalised_line))
    n, first = F.size("_sel"), F.get("_sel", 0)
    open_yet = (F.size("_lit") == 0) & (F.size("_esc") == 0) & (n > 0) & F.col("_near").isNotNull()
    least = threshold(F.char_length(first))
    equal = F.filter("_near.at", lambda i: F.get("_norm", i) == first)
    starts = F.when(F.size(equal) > 0, equal).otherwise(F.filter("_near.at", lambda i, k: F.get("_near.dice", k) >= least))
    must = F.when(n <= 2, F.sequence(F.lit(0), n - 1)).when(n <= 5, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2), n - 2, n - 1))
    passes = lambda i: (i + n <= F.size("_norm")) & F.forall(F.filter(must, lambda k: k > 0), lambda k: F.get("_norm", i + k) == F.get("_sel", k))
    rows = rows.withColumn("_starts", F.when(open_yet, F.filter(starts, passes)).otherwise(F.array().cast("array<int>")))
    at = F.get("_starts", 0)
    # each line takes its terminator with it, which only the last one may lack
    through = lambda k: (k < F.size("_lines")) | F.endswith("t", F.lit("\n"))
    upto = lambda k: F.aggregate(F.slice("_lines", F.lit(1), k), F.lit(0), lambda m, x: m + F.char_length(x) + 1) - F.when(through(k), F.lit(0)).otherwise(F.lit(1))
    moved = reanchored(F.col("r"), F.get("_raw", 0), F.get("_lines", at))
    moved = F.when(through(at + n) & ~F.endswith(moved, F.lit("\n")), F.concat(moved, F.lit("\n"))).otherwise(moved)
    span = lambda a, b, text: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), text.alias("replacement"))
    literal = F.transform("_lit", lambda o: span(o, o + F.char_length("s"), F.col("r")))
    escaped = F.transform("_esc", lambda o: span(o, o + F.char_length("_ds"), F.col("_dr")))
    fuzzy = F.array(span(upto(at), upto(at + n), moved))
    tier = F.when(F.size("_lit") > 0, F.lit("literal")).when(F.size("_esc") > 0, F.lit("escape")).when(F.size("_starts") == 1, F.lit("fuzzy"))
    error = lambda code, lines: F.struct(F.lit(code).alias("code"), F.lit(code.replace("_", " ")).alias("message"), lines.cast("array<int>").alias("lines"))
    many = F.when(tier == "literal", F.size("_lit")).when(tier == "escape", F.size("_esc")).otherwise(F.lit(1))
    several = F.transform(F.when(F.size("_lit") > 0, F.col("_lit")).otherwise(F.col("_esc")), lambda o: line_of(F.col("t"), o))
    several = F.when((many > 1) & ~F.col("all"), several)
    closest = F.array(F.col("_near.closest"))
    none = F.array().cast("array<int>")
    problem = (
        F.when(F.col("_none"), error("file_not_found", none)).when((n == 0) | F.col("unset"), error("invalid_request", none)).when(tier.isNull() & (F.size("_starts") > 1), error("ambiguous_match", F.transform("_starts", lambda i: i + 1)))
        .when(tier.isNull(), error("no_match", closest)).when((many > 1) & ~F.col("all"), error("multiple_matches", several))
    )
    spans = F.when(tier == "literal", literal).when(tier == "escape", escaped).when(tier == "fuzzy", fuzzy)
    return rows.withColumn("error", problem).select(
        "path", "edit_index", "content", F.when(F.col("error").isNull(), spans).alias("spans"), F.when(F.col("error").isNull(), tier).alias("matched_by"), F.when((tier == "fuzzy") & F.col("error").isNull(), F.get("_near.dice", F.array_position("_near.at", at).cast("int") - 1)).alias("dice"), "error"
    )


def applied_spans(text: Column, spans: Column) -> Column:
    """The text with each span of an ordered, disjoint array replaced: what stands before each span, its replacement, and the rest."""
    def piece(span: Column, i: Column) -> Column:
        last = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(F.substring(text, last + 1, span["start"] - last), span["replacement"])

    rest = F.substring(text, F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)) + 1, F.char_length(text))
    return F.concat(F.array_join(F.transform(spans, piece), ""), rest)


PLAN = ["path", "status", "edits_applied", "matched_by", "dice_scores", "after", "pre_sha256", "post_sha256", "diff", "post_context", "error", "file_created"]


def planned(files: DataFrame, edits: DataFrame) -> DataFrame:
    """A row for each edited file: status, content after, hashes before and after, tiers, pseudo-diff, the numbered
    lines around each change, and error.

    Any failing edit fails its file; so does an overlap of two edits. Line ends are kept: CRLF where most are. Contents
    are moved once to be searched and once to be changed, however many edits a file has.
    """
    by_index = F.array_sort(F.collect_list(F.struct("edit_index", "matched_by", "dice")))
    rows = resolved(files, edits).groupBy("path").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"), by_index.alias("_tiers"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("edit_index"))).alias("_error"), F.count(F.lit(1)).alias("edits"),
    ).join(files.select("path", "content"), "path", "left")
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size("_spans") - 1, F.lit(1))), lambda i: F.coalesce(F.get("_spans", i)["start"] < F.get("_spans", i - 1)["end"], F.lit(False)))
    overlap = F.struct(F.lit("overlapping_edits").alias("code"), F.lit("overlapping edits").alias("message"), F.transform("_spans", lambda s: line_of(F.regexp_replace("content", "\r\n?", "\n"), s["start"])).alias("lines")).cast(ERROR)
    rows = rows.withColumn("error", F.coalesce("_error", F.when(clash, overlap)))
    rows = rows.withColumn("_lf", F.regexp_replace("content", "\r\n?", "\n"))
    ok = F.col("error").isNull()
    rows = rows.withColumn("_after", F.when(ok, applied_spans(F.col("_lf"), F.col("_spans"))))
    rows = rows.withColumn("after", F.when(mostly_crlf("content"), F.regexp_replace("_after", "\n", "\r\n")).otherwise(F.col("_after")))
    return rows.select(
        "path", F.when(ok, F.lit("applied")).otherwise(F.lit("failed")).alias("status"), F.when(ok, F.col("edits")).otherwise(F.lit(0)).cast("int").alias("edits_applied"), F.col("_tiers")["matched_by"].alias("matched_by"),
        F.filter(F.col("_tiers")["dice"], lambda d: d.isNotNull()).alias("dice_scores"), "after", F.sha2("content", 256).alias("pre_sha256"), F.sha2("after", 256).alias("post_sha256"),
        F.when(ok, line_diff("content", "after")).alias("diff"), F.when(ok, post_contexts(F.col("_after"), F.col("_spans"))).alias("post_context"), "error", F.lit(False).alias("file_created"),
    ).select(*PLAN)


def mostly_crlf(text: Column | str) -> Column:
    crlf = F.regexp_count(T.col(text), F.lit("\r\n"))
    return crlf > F.regexp_count(T.col(text), F.lit("\n")) - crlf


def rewritten(files: DataFrame, rewrites: DataFrame, create: bool = False) -> DataFrame:
    """planned() for whole new texts (path, rewrite). Files keep their kind of line end and whether the last line has
    one; a path without a file is created with the text as it stands, or fails where `create` is not set."""
    rows = rewrites.select("path", F.coalesce("rewrite", F.lit("")).alias("_new")).join(files.select("path", "content"), "path", "left")
    new = F.col("content").isNull()
    ok = ~new | F.lit(create)
    lf = F.regexp_replace("_new", "\r\n?", "\n")
    open_ended = F.regexp_replace(lf, "\n\\z", "")
    shaped = F.when(F.endswith("content", F.lit("\n")), F.concat(open_ended, F.lit("\n"))).otherwise(open_ended)
    after = F.when(new, F.col("_new")).when(mostly_crlf("content"), F.regexp_replace(shaped, "\n", "\r\n")).otherwise(shaped)
    rows = rows.withColumn("after", F.when(ok, after)).withColumn("_before", F.coalesce("content", F.lit(""))).withColumn("_lf", F.regexp_replace("after", "\r\n", "\n"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    missing = F.struct(F.lit("file_not_found").alias("code"), F.lit("file not found").alias("message"), none("int").alias("lines")).cast(ERROR)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length("_lf").alias("end"), F.col("_lf").alias("replacement")))
    return rows.select(
        "path", F.when(ok, F.lit("applied")).otherwise(F.lit("failed")).alias("status"), ok.cast("int").alias("edits_applied"), F.when(ok, F.array(F.lit("rewrite"))).otherwise(none("string")).alias("matched_by"),
        none("double").alias("dice_scores"), "after", F.sha2("_before", 256).alias("pre_sha256"), F.sha2("after", 256).alias("post_sha256"), F.when(ok, line_diff("_before", "after")).alias("diff"),
        F.when(ok, post_contexts(F.col("_lf"), whole)).alias("post_context"), F.when(~ok, missing).alias("error"), (new & ok).alias("file_created"),
    ).select(*PLAN)


def line_diff(before: Column | str, after: Column | str) -> Column:
    """Lines that the other side has nowhere, marked - and +, repeats included.

    The two set differences are worked out once (by hashing); the lines are then looked up in these short arrays.
    """
    def both(s: Column) -> Column:
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_except(s["a"], s["b"]).alias("gone"), F.array_except(s["b"], s["a"]).alias("new"))

    def marked(s: Column) -> Column:
        gone = F.transform(F.filter(s["a"], lambda x: F.array_contains(s["gone"], x)), lambda x: F.concat(F.lit("-"), x))
        return F.concat(gone, F.transform(F.filter(s["b"], lambda x: F.array_contains(s["new"], x)), lambda x: F.concat(F.lit("+"), x)))

    # a one-element array binds the lines, so that no lambda cuts the texts again
    held = F.transform(F.transform(F.array(F.struct(T.lines(before).alias("a"), T.lines(after).alias("b"))), both), marked)
    return F.get(held, 0)


def post_contexts(after: Column, spans: Column, around: int = 3) -> Column:
    """For each span of an applied array: start_line and end_line of what was put in, and the numbered lines around it."""
    size = lambda p: F.char_length(p["replacement"])
    start = F.struct(F.lit(0).alias("moved"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    put = F.aggregate(
        spans, start,
        lambda s, p: F.struct((s["moved"] + size(p) - (p["end"] - p["start"])).cast("int").alias("moved"), F.concat(s["out"], F.array(F.struct((p["start"] + s["moved"]).alias("a"), (p["start"] + s["moved"] + size(p)).cast("int").alias("b")))).alias("out")),
        lambda s: s["out"],
    )
    placed = F.transform(put, lambda r: F.struct(line_of(after, r["a"]).cast("int").alias("a"), line_of(after, F.greatest(r["a"], r["b"] - 1)).cast("int").alias("b")))

    def shown(held: Column, r: Column) -> Column:
        first = F.greatest(F.lit(1), r["a"] - around)
        part = F.slice(held, first, r["b"] + around - first + 1)
        return F.struct(r["a"].alias("start_line"), r["b"].alias("end_line"), F.array_join(F.transform(part, lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x)), "\n").alias("text"))

    # a one-element array binds the lines, so that no span cuts the text again
    return F.get(F.transform(F.array(T.lines(after)), lambda held: F.transform(placed, lambda r: shown(held, r))), 0)


def inside(root: str, path: str) -> Path:
    """A path below the root; the root itself and what lies outside are refused."""
    base = Path(root).resolve()
    found = (base / path).resolve()
    if found == base or base not in found.parents:
        raise ValueError(f"outside_workspace: {path}")
    return found


def write_atomically(path: Path, text: str) -> None:
    """A temporary file beside the target, flushed, then put in its place."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(name, path)


def commit(plan: DataFrame, root: str, expected: dict[str, str] | None = None, dry_run: bool = False, changed: Callable[[list[str]], None] | None = None) -> list[dict]:
    """Writes planned files of a local workspace one after another and reads each back; a workspace's edits are few.

    A file whose content is no longer what the plan was made from is left alone. `changed` is called with the paths
    that were written, so that what was derived from them (catalogs, codemaps) can go.
    """
    found, written = [], []
    for row in plan.orderBy("path").toLocalIterator():
        result = {"path": row["path"], "status": row["status"], "edits_applied": row["edits_applied"], "file_created": row["file_created"], "error": row["error"].asDict() if row["error"] else None}
        if row["status"] == "applied":
            result["post_context"] = [c.asDict() for c in row["post_context"]]
            target = inside(root, row["path"])
            now = hashlib.sha256(target.read_bytes() if target.exists() else b"").hexdigest()
            if now != row["pre_sha256"] or (expected or {}).get(row["path"], now) != now:
                result |= {"status": "failed", "edits_applied": 0, "error": {"code": "hash_mismatch", "message": "the file has changed", "lines": []}}
            elif not dry_run:
                write_atomically(target, row["after"])
                written.append(row["path"])
                if hashlib.sha256(target.read_bytes()).hexdigest() != row["post_sha256"]:
                    result |= {"status": "failed", "error": {"code": "verify_failed", "message": "the file written is not the one planned", "lines": []}}
        found.append(result)
    if written and changed is not None:
        changed(written)
    return found


def file_action(root: str, action: str, path: str, content: str | None = None, new_path: str | None = None, overwrite: bool = False, expected_sha256: str | None = None) -> dict:
    """create, delete or move one file of a workspace, with guards against overwriting and against changed files."""
    target = inside(root, path)
    if expected_sha256 is not None and (not target.exists() or hashlib.sha256(target.read_bytes()).hexdigest() != expected_sha256):
        return {"path": path, "error": {"code": "hash_mismatch"}}
    if action == "create":
        if target.exists() and not overwrite:
            return {"path": path, "error": {"code": "file_exists"}}
        write_atomically(target, content or "")
    elif not target.exists():
        return {"path": path, "error": {"code": "file_not_found"}}
    elif action == "delete":
        target.unlink()
    elif action == "move":
        to = inside(root, new_path or "")
        if to.exists() and not overwrite:
            return {"path": path, "error": {"code": "file_exists"}}
        to.parent.mkdir(parents=True, exist_ok=True)
        os.replace(target, to)
    else:
        raise ValueError(f"unknown action: {action}")
    return {"path": new_path if action == "move" else path, "status": action}
