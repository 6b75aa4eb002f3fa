"""A selection of files and line ranges as a table, its updates as joins, and its token totals.

selection: session_id, path, mode (full, slices or codemap), slices array<struct<start,end,description>>,
content_sha256, tokens_full, tokens_slices, tokens_codemap, slices_invalidated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import intervals

SLICES = "array<struct<start:int,end:int,description:string>>"
SCHEMA = f"session_id string, path string, mode string, slices {SLICES}, content_sha256 string, tokens_full long, tokens_slices long, tokens_codemap long, slices_invalidated boolean"
_KEY = ["session_id", "path"]


def measured(entries: DataFrame, files: DataFrame, codemaps: DataFrame | None = None) -> DataFrame:
    """entries (session_id, path, mode, slices) that have a file, with its hash, normalised slices and tokens.

    Slices are clamped to the file's lines and merged; their tokens are the sum over slices. Unknown paths go.
    """
    whole = files.select("path", F.sha2("content", 256).alias("content_sha256"), T.estimate_tokens("content").alias("tokens_full"))
    texts = files.join(entries.where("mode = 'slices'").select("path").distinct(), "path", "left_semi").select("path", T.lines_kept("content").alias("_lines"))
    rows = entries.join(whole, "path").join(texts, "path", "left").withColumn("_lines", F.when(F.col("mode") == "slices", F.col("_lines")))
    spread = rows.where("mode = 'slices'").select(F.concat_ws("\u0000", "session_id", "path").alias("_k"), F.size("_lines").alias("_last"), F.inline("slices"))
    merged = intervals.normalise(spread, "_k", last="_last", note="description").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "description"))).alias("_merged"))
    rows = rows.drop("slices").withColumn("_k", F.concat_ws("\u0000", "session_id", "path")).join(merged, "_k", "left")
    none = F.array().cast(SLICES)
    rows = rows.withColumn("slices", F.coalesce(F.col("_merged").cast(SLICES), none))
    each = F.transform("slices", lambda s: T.estimate_tokens(F.array_join(F.slice(F.col("_lines"), s["start"], s["end"] - s["start"] + 1), "")))
    rows = rows.withColumn("tokens_slices", F.aggregate(each, F.lit(0).cast("long"), lambda n, t: n + t))
    if codemaps is not None:
        rows = rows.join(codemaps.select("path", T.estimate_tokens("text").alias("tokens_codemap")), "path", "left")
    else:
        rows = rows.withColumn("tokens_codemap", F.lit(None).cast("long"))
    return rows.select("session_id", "path", "mode", "slices", "content_sha256", "tokens_full", "tokens_slices", F.coalesce("tokens_codemap", F.lit(0)).cast("long").alias("tokens_codemap"), F.lit(False).alias("slices_invalidated"))


def add(selection: DataFrame, entries: DataFrame, files: DataFrame, codemaps: DataFrame | None = None) -> DataFrame:
    """Upsert: slices join the slices that a path has, any other mode replaces the entry."""
    old = selection.select(*_KEY, F.col("mode").alias("_mode"), F.col("slices").alias("_slices"))
    joined = entries.join(old, _KEY, "left")
    both = F.when((F.col("mode") == "slices") & (F.col("_mode") == "slices"), F.concat("_slices", F.col("slices").cast(SLICES))).otherwise(F.col("slices").cast(SLICES))
    fresh = measured(joined.select(*_KEY, "mode", both.alias("slices")), files, codemaps)
    return selection.join(fresh, _KEY, "left_anti").unionByName(fresh)


def replace(selection: DataFrame, entries: DataFrame, files: DataFrame, codemaps: DataFrame | None = None) -> DataFrame:
    """The sessions of `entries` hold nothing but them; other sessions stay."""
    others = selection.join(entries.select("session_id").distinct(), "session_id", "left_anti")
    return others.unionByName(measured(entries, files, codemaps))


def remove(selection: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """Paths without slices leave; of a sliced entry, given slices are cut out, and it leaves when none is left."""
    what = entries.select(*_KEY, F.col("slices").alias("_cut"))
    touched = selection.join(what, _KEY)
    partial = touched.where("mode = 'slices' AND size(_cut) > 0").withColumn("_k", F.concat_ws("\u0000", *_KEY))
    left = intervals.subtract(partial.select("_k", F.inline("slices")), partial.select("_k", F.inline("_cut")), "_k")
    notes = partial.select("_k", F.inline("slices")).select("_k", F.col("start").alias("_s"), F.col("end").alias("_e"), "description")
    left = left.join(notes, "_k").where("start >= _s AND end <= _e").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "description"))).alias("slices"))
    again = measured(partial.select("_k", *_KEY, "mode").join(left, "_k").select(*_KEY, "mode", F.col("slices").cast(SLICES).alias("slices")), files)
    return selection.join(what, _KEY, "left_anti").unionByName(again)


def set_mode(selection: DataFrame, paths: DataFrame, mode: str, auto: DataFrame | None = None) -> DataFrame:
    """promote (full) or demote (codemap) of paths that are selected or, with `auto`, that closure has found."""
    wanted = paths.select(*_KEY, F.lit(True).alias("_w"))
    if auto is not None:
        missing = auto.join(selection, _KEY, "left_anti").join(wanted, _KEY, "left_semi")
        selection = selection.unionByName(missing.select(*selection.columns))
    rows = selection.join(wanted, _KEY, "left")
    hit = F.coalesce("_w", F.lit(False))
    return rows.withColumn("mode", F.when(hit, F.lit(mode)).otherwise(F.col("mode"))).withColumn("slices", F.when(hit, F.array().cast(SLICES)).otherwise(F.col("slices"))).select(*selection.columns)


def forget(selection: DataFrame, paths: DataFrame) -> DataFrame:
    return selection.join(paths.select("path"), "path", "left_anti").select(*selection.columns)


def invalidate(selection: DataFrame, files: DataFrame) -> DataFrame:
    """Entries against the files as they are: new hashes and tokens; slices of changed files turn to full."""
    now = files.select("path", F.sha2("content", 256).alias("_sha"), T.estimate_tokens("content").alias("_full"))
    rows = selection.join(now, "path", "left")
    changed = F.col("_sha").isNotNull() & (F.col("_sha") != F.col("content_sha256"))
    lost = changed & (F.col("mode") == "slices")
    return rows.select(
        "session_id", "path", F.when(lost, F.lit("full")).otherwise(F.col("mode")).alias("mode"), F.when(lost, F.array().cast(SLICES)).otherwise(F.col("slices")).alias("slices"),
        F.coalesce("_sha", "content_sha256").alias("content_sha256"), F.when(changed, F.col("_full")).otherwise(F.col("tokens_full")).alias("tokens_full"),
        F.when(lost, F.lit(0)).otherwise(F.col("tokens_slices")).cast("long").alias("tokens_slices"), "tokens_codemap", (lost | F.col("slices_invalidated")).alias("slices_invalidated"),
    )


def entry_tokens():
    return F.when(F.col("mode") == "full", F.col("tokens_full")).when(F.col("mode") == "slices", F.col("tokens_slices")).otherwise(F.col("tokens_codemap"))


def totals(selection: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """Per session: files, files by mode, tokens by mode, prompt tokens and the total."""
    tokens = lambda mode: F.coalesce(F.sum(F.when(F.col("mode") == mode, entry_tokens())), F.lit(0))
    sums = selection.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("mode") == m).alias(f"{m}_files") for m in ("full", "slices", "codemap")], *[tokens(m).alias(f"{m}_tokens") for m in ("full", "slices", "codemap")]
    )
    if prompts is not None:
        sums = sums.join(prompts.select("session_id", T.estimate_tokens("prompt").alias("prompt_tokens")), "session_id", "left").withColumn("prompt_tokens", F.coalesce("prompt_tokens", F.lit(0)))
    else:
        sums = sums.withColumn("prompt_tokens", F.lit(0).cast("long"))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("full_tokens") + F.col("slices_tokens") + F.col("codemap_tokens"))


def closure(selection: DataFrame, references: DataFrame, type_index: DataFrame) -> DataFrame:
    """(session_id, path) that define a type which a selected file (not taken as codemap) refers to, and are not selected.

    references: path, type_name. type_index: type_name, path.
    """
    used = selection.where("mode <> 'codemap'").select("session_id", "path").join(references, "path").select("session_id", "type_name").distinct()
    found = used.join(type_index, "type_name").select("session_id", "path").distinct()
    return found.join(selection.select(*_KEY), _KEY, "left_anti").select(*_KEY)


def with_auto(selection: DataFrame, auto: DataFrame, files: DataFrame, codemaps: DataFrame) -> DataFrame:
    """The snapshot: explicit entries and those of the closure as codemaps, with `auto`."""
    entries = auto.select(*_KEY, F.lit("codemap").alias("mode"), F.array().cast(SLICES).alias("slices"))
    return selection.withColumn("auto", F.lit(False)).unionByName(measured(entries, files, codemaps).withColumn("auto", F.lit(True)))


def missing(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requested paths without a file: what strict views refuse."""
    return requests.join(files.select("path"), "path", "left_anti")


def latest(events: DataFrame, order: str) -> DataFrame:
    """The last state of each (session_id, path) in a log of upserts; a null mode means it has left."""
    last = events.withColumn("_n", F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc(order)))).where("_n = 1 AND mode IS NOT NULL")
    return last.drop("_n")


def save(selection: DataFrame, folder: str) -> None:
    """Writes each session in its own partition; sessions that are not in the table stay as they are."""
    selection.write.partitionBy("session_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def load(spark, folder: str, session_id: str) -> DataFrame:
    """A session's entries; the partition filter reads no other session."""
    return spark.read.schema(SCHEMA).parquet(folder).where(F.col("session_id") == session_id)


def session_key(session_id: str, scope: str) -> str:
    """All sessions of a workspace share one selection where its scope is `workspace`."""
    return "shared" if scope == "workspace" else session_id


def cleared(selection: DataFrame, prompts: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """A selection and prompts (session_id, prompt) without one session's entries and prompt."""
    other = F.col("session_id") != session_id
    return selection.where(other), prompts.where(other)


def save_profile(selection: DataFrame, folder: str, session_id: str, name: str) -> None:
    """Keeps a session's entries under a name; what the name held before goes."""
    rows = selection.where(F.col("session_id") == session_id).drop("session_id").withColumn("profile", F.lit(name))
    rows.write.partitionBy("profile").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def load_profile(spark, folder: str, name: str, session_id: str) -> DataFrame:
    """A profile's entries as those of a session."""
    stored = SCHEMA.replace("session_id string", "profile string")
    rows = spark.read.schema(stored).parquet(folder).where(F.col("profile") == name)
    return rows.withColumn("session_id", F.lit(session_id)).select("session_id", *[c for c in rows.columns if c != "profile"])


def profiles(spark, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA.replace("session_id string", "profile string")).parquet(folder).select("profile").distinct()


def view(snapshot: DataFrame, kind: str, files: DataFrame | None = None, codemaps: DataFrame | None = None) -> DataFrame:
    """A selection as `summary` (totals), `files` (a row each with its tokens), `content` (text of full and sliced
    entries) or `codemaps` (structure of those taken as such)."""
    if kind == "summary":
        return totals(snapshot)
    if kind == "files":
        return snapshot.select(*_KEY, "mode", "slices", entry_tokens().alias("tokens"), "slices_invalidated")
    if kind == "content":
        rows = snapshot.where("mode <> 'codemap'").join(files.select("path", "content"), "path")
        lines = T.lines_kept("content")
        parts = F.flatten(F.transform("slices", lambda s: F.slice(lines, s["start"], s["end"] - s["start"] + 1)))
        return rows.select(*_KEY, F.when(F.col("mode") == "slices", F.array_join(parts, "")).otherwise(F.col("content")).alias("text"))
    if kind == "codemaps":
        return snapshot.where("mode = 'codemap'").join(codemaps.select("path", "text"), "path").select(*_KEY, "text")
    raise ValueError(f"unknown view: {kind}")


def prompts_after(events: DataFrame, order: str = "at") -> DataFrame:
    """(session_id, prompt, tokens) after a log of prompt events: set and clear start anew, append adds as it stands."""
    by_time = Window.partitionBy("session_id").orderBy(order)
    restarts = F.sum(F.col("action").isin("set", "clear").cast("int")).over(by_time)
    last = Window.partitionBy("session_id")
    rows = events.withColumn("_epoch", F.coalesce(restarts, F.lit(0))).withColumn("_last", F.max("_epoch").over(last)).where("_epoch = _last")
    said = F.when(F.col("action") == "clear", F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    whole = rows.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), said.alias("text"))))["text"], "").alias("prompt"))
    return whole.withColumn("tokens", T.estimate_tokens("prompt"))
