"""Packaging: intent, presets, file blocks, sections, the payload with its hash, its token breakdown and receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators import ordering, tree
from lodestone.operators import selection as S

# Phrases that ask for a review, the sections in their order, and the prompts' texts.
REVIEW_PHRASES = [
    "review mode", "code review", "review changes", "review the changes", "review the diff", "review the pr", "review this pr", "review pull request", "review my changes", "review my pr",
    "git diff", "pull request", "pr review", "compare branch", "compare main", "compare master",
]
SECTIONS = ["file_map", "file_contents", "git_diff", "meta_prompts", "user_instructions"]
META_PROMPTS = {
    "Architect": "Plan before editing. Identify modules, risks, steps, and verification.",
    "Review": "Review changes with severity-ranked findings, tests, and risks.",
    "MVP": "Focus context on routes, entrypoints, build configuration, manifests, and the smallest user-visible path that proves the MVP works.",
}


def review_intent(response_type: Column, instructions: Column) -> Column:
    """True where a review is asked for, by type, by phrase, or by the words git and diff(s)."""
    low = F.lower(F.coalesce(instructions, F.lit("")))
    tokens = F.split(low, "[^a-z0-9]+")
    phrase = P.any_of([F.contains(low, F.lit(p)) for p in REVIEW_PHRASES])
    return (F.lower(F.coalesce(response_type, F.lit(""))) == "review") | phrase | (F.array_contains(tokens, "git") & F.arrays_overlap(tokens, F.array(F.lit("diff"), F.lit("diffs"))))


def preset(explicit: Column, response_type: Column, instructions: Column, names: list[str]) -> Column:
    """The preset's name: the one asked for, else a response type that names one, else review by intent, else standard."""
    wanted = F.coalesce(explicit, F.when(response_type.isin(names), response_type), F.when(review_intent(response_type, instructions), F.lit("review")), F.lit("standard"))
    return F.when(wanted.isin(names), wanted).otherwise(F.lit("standard"))


def file_blocks(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(session_id, path, block) for full and sliced entries: a fenced text, or one for each slice with its lines.

    A selected path without a file ends the job.
    """
    rows = entries.where("mode <> 'codemap'").join(files.select("path", "content"), "path", "left")
    content = F.coalesce("content", F.raise_error(F.concat(F.lit("no such file: "), "path")))
    fenced = lambda t: F.concat(F.lit("```"), P.fence("path"), F.lit("\n"), F.regexp_replace(t, "\\s+$", ""), F.lit("\n```"))
    lines = T.lines_kept("_text")
    note = lambda s: F.when(F.coalesce(F.char_length(s["description"]), F.lit(0)) > 0, F.concat(F.lit(": "), s["description"])).otherwise(F.lit(""))
    label = lambda s: F.concat(F.lit("(lines "), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), note(s), F.lit(")\n"))
    parts = F.transform("slices", lambda s: F.concat(label(s), fenced(F.array_join(F.slice(lines, s["start"], s["end"] - s["start"] + 1), ""))))
    body = F.when(F.col("mode") == "full", fenced(F.col("_text"))).otherwise(F.array_join(parts, "\n\n"))
    return rows.withColumn("_text", content).select("session_id", "path", F.concat(F.lit("File: "), "path", F.lit("\n"), body).alias("block"))


def file_map(entries: DataFrame, codemaps: DataFrame, usage: str = "auto", trees: DataFrame | None = None) -> DataFrame:
    """(session_id, section, text): a session's tree (trees: session_id, tree) and the structure of its codemap entries
    by path, in one row; file_map_parts() is for selections that no budget bounds. usage: `auto` takes all of them,
    `selected` leaves out those that closure found (auto), `none` takes none."""
    parts = _mapped(entries, codemaps, usage).select("session_id", F.lit(1).alias("k"), "path", "text")
    if trees is not None:
        parts = parts.unionByName(trees.select("session_id", F.lit(0).alias("k"), F.lit("").alias("path"), F.regexp_replace("tree", "\\s+$", "").alias("text")))
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("k", "path", "text")))["text"], "\n\n")
    return parts.where("text <> ''").groupBy("session_id").agg(whole.alias("text")).select("session_id", F.lit("file_map").alias("section"), "text")


def _mapped(entries: DataFrame, codemaps: DataFrame, usage: str) -> DataFrame:
    """(session_id, path, text): the structures of the codemap entries that `usage` takes."""
    if usage not in ("auto", "selected", "none"):
        raise ValueError(f"unknown codemap usage: {usage}")
    chosen = entries.where("mode = 'codemap'" if usage != "none" else "false")
    if usage == "selected" and "auto" in entries.columns:
        chosen = chosen.where(~F.coalesce("auto", F.lit(False)))
    return chosen.join(codemaps.select("path", "text"), "path").select("session_id", "path", F.regexp_replace("text", "\\s+$", "").alias("text"))


def file_map_parts(entries: DataFrame, codemaps: DataFrame, usage: str = "auto", trees: DataFrame | None = None, budget: int = 10_000) -> DataFrame:
    """(session_id, section, part, text): file maps in parts from 0, whose texts one after another are a session's map.

    trees: (session_id, place, line) as tree.of_sessions() gives them. A part holds the lines and structures that begin
    within the same `budget` tokens of a running sum over all sessions, so it exceeds them by one structure at most, and
    no task needs more than a range of the order. Entries without a codemap text give nothing; nor does a null session.
    """
    if budget < 1:
        raise ValueError("a part needs room for a token")
    place = "array<struct<rank:int,name:string>>"
    # what comes before a piece belongs to it; a session's first piece has nothing before it
    pieces = _mapped(entries, codemaps, usage).where("text <> '' AND session_id IS NOT NULL").select("session_id", F.lit(1).alias("k"), F.lit(None).cast(place).alias("place"), "path", F.lit("\n\n").alias("lead"), "text")
    if trees is not None:
        first = F.size("place") == 0
        drawn = F.when(first, F.concat(F.lit(tree.HEAD + "\n"), "line")).otherwise(F.col("line"))
        pieces = pieces.unionByName(trees.select("session_id", F.lit(0).alias("k"), F.col("place").cast(place).alias("place"), F.lit("").alias("path"), F.when(first, F.lit("")).otherwise(F.lit("\n")).alias("lead"), drawn.alias("text")))
    order = ["session_id", "k", "place", "path"]
    rows = ordering.summed(pieces.withColumn("cost", T.estimate_tokens(F.concat("lead", "text")) + 1), order, "cost", "before")
    begins = rows.groupBy("session_id").agg(F.min("before").alias("_begin"))
    rows = rows.join(begins, "session_id").withColumn("part", (F.floor(F.col("before") / budget) - F.floor(F.col("_begin") / budget)).cast("long"))
    own = F.when(F.col("before") == F.col("_begin"), F.col("text")).otherwise(F.concat("lead", "text"))
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("before", own.alias("own"))))["own"], "")
    return rows.groupBy("session_id", "part").agg(whole.alias("text")).select("session_id", F.lit("file_map").alias("section"), "part", "text")


def joined_blocks(blocks: DataFrame, text: str = "block") -> DataFrame:
    """(session_id, text): a session's blocks in path order. A selection is what a token budget admits, so one row holds it."""
    return blocks.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", text))), lambda b: b[text]), "\n\n").alias("text"))


def in_bundles(entries: DataFrame, budget: int) -> DataFrame:
    """entries with sessions cut, in path order, into bundles of about `budget` tokens: `<session>#<number>`.

    A bundle holds the entries that begin within the same `budget` tokens of the running sum, so only its last entry
    may reach beyond them. Each entry costs something for its path, so that no bundle has very many.
    """
    cost = F.coalesce(S.entry_tokens(), F.lit(0)) + T.estimate_tokens("path") + 8
    placed = ordering.summed(entries.withColumn("_cost", cost), ["session_id", "path"], "_cost", "_before")
    number = F.floor(F.col("_before") / budget).cast("string")
    return placed.withColumn("session_id", F.concat("session_id", F.lit("#"), number)).drop("_cost", "_before")


def meta_prompts(names: list[str]) -> str:
    """The preset's prompts as tagged texts; an unknown name is its own text."""
    found = []
    for k, name in enumerate(names, 1):
        shown = name.replace("&", "&amp;").replace('"', "&quot;")
        found.append(f'<meta prompt {k} = "{shown}">\n{META_PROMPTS.get(name, name).strip()}\n</meta prompt {k}>')
    return "\n\n".join(found)


def payload(sections: DataFrame, order: list[str] = SECTIONS, instructions_first: bool = False) -> DataFrame:
    """(session_id, text, content_sha256, tokens) from (session_id, section, text) rows. Blank sections go; sections
    that the order does not name follow it by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("section")), F.lit(0)), F.lit(len(order) + 1))
    body = F.rtrim(F.col("text"))
    tagged = F.when(F.col("section") == "meta_prompts", F.col("text")).otherwise(F.concat(F.lit("<"), "section", F.lit(">\n"), body, F.lit("\n</"), "section", F.lit(">\n")))
    rows = sections.where(F.trim("text") != "").withColumn("_s", F.struct(place.alias("place"), "section", tagged.alias("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["text"]), "\n")
    whole = rows.groupBy("session_id").agg(text.alias("text"), F.max(F.when(F.col("section") == "user_instructions", F.col("_s.text"))).alias("_own"))
    if instructions_first:
        whole = whole.withColumn("text", F.when(F.col("_own").isNotNull(), F.concat("_own", F.lit("\n"), "text")).otherwise(F.col("text")))
    whole = whole.withColumn("text", F.regexp_replace("text", "\\s+$", ""))
    return whole.select("session_id", "text", F.sha2("text", 256).alias("content_sha256"), T.estimate_tokens("text").alias("tokens"))


def breakdown(sections: DataFrame, entries: DataFrame, payloads: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """Tokens by section and by mode for each session. total is that of the whole text, not the sum of the parts."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col("section") == name, T.estimate_tokens("text"))), F.lit(0))
    by_section = sections.groupBy("session_id").agg(of("user_instructions").alias("instructions"), of("file_map").alias("file_tree"), of("git_diff").alias("git_diff"), of("meta_prompts").alias("meta_prompts"))
    by_mode = S.totals(entries, prompts).select("session_id", F.col("prompt_tokens").alias("prompt"), F.col("full_tokens").alias("files_full"), F.col("slices_tokens").alias("files_slices"), F.col("codemap_tokens").alias("codemaps"))
    return by_mode.join(by_section, "session_id", "left").join(payloads.select("session_id", F.col("tokens").alias("total")), "session_id", "left").na.fill(0)


def receipt(entries: DataFrame, payloads: DataFrame, tokens: DataFrame, preset_name: str, budget: int, generated_at: str) -> DataFrame:
    """(session_id, receipt): a JSON record of what a payload was made of."""
    files = entries.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("path", "mode", S.entry_tokens().alias("tokens")))).alias("files"))
    parts = [c for c in tokens.columns if c != "session_id"]
    rows = files.join(payloads, "session_id").join(tokens.select("session_id", F.struct(*parts).alias("token_breakdown")), "session_id")
    body = F.struct(F.lit(generated_at).alias("generated_at"), F.lit(preset_name).alias("preset"), F.lit(budget).alias("budget"), "files", "token_breakdown", F.col("content_sha256").alias("content_hash"))
    return rows.select("session_id", F.to_json(body).alias("receipt"))
