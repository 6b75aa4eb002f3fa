"""Search over files by path and by content: match, rank and shape, as one plan of DataFrame operations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators import budget, ordering

#: Columns of a match.
MATCH = ["path", "line", "col", "match_text", "context_before", "context_after", "kind", "score"]
#: A query with one of these looks like a path pattern.
_PATH_SIGNS = re.compile(r"[/*?\[\]{}]")
#: The first matches are worth up to FIRST for their place, the latest paths up to RECENT for theirs.
FIRST, RECENT, MAX_CHARS = 1000, 200, 50_000
#: A search that may stop early cuts the paths into at most SLICES ranges, known by SAMPLED paths each. It takes the first
#: one, then GROWTH times as many at each step, until it has its matches or they show more than SHOWN_BYTES.
SLICES, SAMPLED, GROWTH, SHOWN_BYTES = 256, 8, 8, 16 * 1024 * 1024
_TOO_MANY = "More matched than is shown: use a longer pattern, fewer paths or extensions, or less context."
_NOT_LINEAR = re.compile(r"\(\?<?[=!]|\\[1-9]")


def resolve_mode(pattern: str, mode: str = "auto") -> str:
    """`path` for what looks like a path pattern, else `both`; another mode than `auto` stays."""
    if mode not in ("auto", "path", "content", "both"):
        raise ValueError(f"unknown search mode: {mode}")
    return mode if mode != "auto" else "path" if _PATH_SIGNS.search(pattern) else "both"


def narrowed(files: DataFrame, paths: list[str] = (), extensions: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """The files that the path, extension and exclude filters leave. An empty list filters nothing."""
    return files.where(P.under("path", list(paths)) & P.with_extension("path", list(extensions)) & P.not_excluded("path", list(exclude)))


def searchable(files: DataFrame) -> DataFrame:
    """Files whose content is searched: neither binary nor oversized nor generated; flags that are absent do not count."""
    for flag in ("is_binary", "oversized", "likely_generated"):
        if flag in files.columns:
            files = files.where(~F.coalesce(F.col(flag), F.lit(False)))
    return files


def path_matches(files: DataFrame, query: str, threshold: float = 0.35) -> DataFrame:
    """Paths that hold the query (500) or are alike by Dice over `threshold` (400 times it), by score and path."""
    low = F.lower("path")
    dice = T.path_dice(query, low)
    score = F.when(F.contains(low, F.lit(query.lower())), F.lit(500.0)).when(dice >= threshold, dice * 400)
    return files.select("path", score.alias("score")).where("score > 0")


def line_table(files: DataFrame, content: str = "content", text_filter: Column | None = None) -> DataFrame:
    """(path, line_no from 1, line) of all lines."""
    source = files if text_filter is None else files.where(text_filter)
    return source.select("path", F.posexplode(T.lines(content)).alias("_n", "line")).select("path", (F.col("_n") + 1).alias("line_no"), "line")


def pattern_of(query: str, regex: bool = False, whole_word: bool = False, java: bool = False) -> str:
    """The expression that lines are held against. Look-around and back references need java=True."""
    if regex and not java and _NOT_LINEAR.search(query):
        raise ValueError("look-around and back references are not part of the search dialect")
    body = query if regex else re.escape(query)
    return f"(?U)(?<!\\w)(?:{body})(?!\\w)" if whole_word else body


def content_matches(files: DataFrame, query: str, regex: bool = False, whole_word: bool = False, java: bool = False, content: str = "content", around: int | None = None) -> DataFrame:
    """(path, line, col, match_text): a row for each line with a match, at its first one. col counts bytes from 1.

    With `around`, also context_before and context_after. A line between two matches of a file is shown once: it belongs
    to the next match if that is within reach, else to the one before. A file's lines are matched where they lie, and
    only matches leave its row.
    """
    plain = not regex and not whole_word
    pattern = F.lit(query if plain else pattern_of(query, regex, whole_word, java))
    fits = lambda line: F.contains(line, pattern) if plain else F.regexp_like(line, pattern)
    rows = files.where(F.contains(F.col(content), pattern)) if plain else files
    if around is None:
        hits = line_table(rows, content).where(fits(F.col("line"))).withColumnRenamed("line", "_text").withColumnRenamed("line_no", "line")
        context = []
    else:
        numbered = F.transform(T.lines(content), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        rows = rows.select("path", numbered.alias("_lines")).withColumn("_hits", F.filter("_lines", lambda h: fits(h["x"])))
        n = F.size("_lines")

        def shown(h: Column, k: Column) -> Column:
            first = F.greatest(F.coalesce(F.get("_hits", k - 1)["i"] + 1, F.lit(0)), h["i"] - around)
            last = F.least(n - 1, h["i"] + around, F.coalesce(F.get("_hits", k + 1)["i"] - around - 1, n))
            part = lambda start, count: F.transform(F.slice("_lines", start + 1, F.greatest(count, F.lit(0))), lambda y: y["x"])
            return F.struct((h["i"] + 1).alias("line"), h["x"].alias("_text"), part(first, h["i"] - first).alias("context_before"), part(h["i"] + 1, last - h["i"]).alias("context_after"))

        hits = rows.select("path", F.inline(F.transform("_hits", shown)))
        context = ["context_before", "context_after"]
    at = F.locate(query, "_text") if plain else F.regexp_instr("_text", pattern)
    found = F.lit(query) if plain else F.regexp_substr("_text", pattern)
    return hits.select("path", "line", (F.octet_length(F.substring("_text", F.lit(1), at - 1)) + 1).alias("col"), found.alias("match_text"), *context)


def with_context(matches: DataFrame, lines: DataFrame, around: int) -> DataFrame:
    """Matches from elsewhere with the lines (path, line_no, line) around them, as content_matches() gives them. A line between two matches of a file is shown once: it belongs to the
    next match if it is within reach of it, else to the one before."""
    hits = matches.select("path", F.col("line").alias("line_no"), F.lit(True).alias("_hit")).distinct()
    near = hits.select("path", F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("line_no")).distinct()
    shown = lines.join(near, ["path", "line_no"]).join(hits, ["path", "line_no"], "left")
    hit_line = F.when(F.col("_hit"), F.col("line_no"))
    order = Window.partitionBy("path").orderBy("line_no")
    owned = shown.withColumn("_next", F.first(hit_line, ignorenulls=True).over(order.rowsBetween(1, around))).withColumn("_last", F.last(hit_line, ignorenulls=True).over(order.rowsBetween(-around, -1)))
    owned = owned.where("_hit IS NULL").withColumn("_before", (F.col("_next") - F.col("line_no") <= around) & F.col("_next").isNotNull())
    owned = owned.withColumn("_owner", F.when(F.col("_before"), F.col("_next")).otherwise(F.col("_last")))
    text = F.struct("line_no", "line")
    context = owned.groupBy("path", F.col("_owner").alias("line")).agg(
        F.array_sort(F.collect_list(F.when(F.col("_before"), text)))["line"].alias("context_before"), F.array_sort(F.collect_list(F.when(~F.col("_before"), text)))["line"].alias("context_after")
    )
    none = F.array().cast("array<string>")
    return matches.join(context, ["path", "line"], "left").withColumns({c: F.coalesce(c, none) for c in ("context_before", "context_after")})


def recency(history: DataFrame, path: str = "path", position: str = "pos", top: int | None = None) -> DataFrame:
    """(path, rank from 0) by where a path first shows in the history. top: only so many paths, ranked by one task; a
    score asks for the first RECENT."""
    first = history.groupBy(F.col(path).alias("path")).agg(F.min(position).alias("_first"))
    if top is None:
        return ordering.numbered(first, ["_first", "path"], "rank").drop("_first").withColumn("rank", F.col("rank").cast("int"))
    return _placed(first, ["_first", "path"], top, "rank", 0).drop("_first")


def _placed(rows: DataFrame, order: list[Column | str], top: int, column: str, first: int) -> DataFrame:
    """The first `top` rows with their place in the order: a top-k in every task, then one task for those."""
    return rows.orderBy(*order).limit(top).withColumn(column, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + (first - 1)).cast("int"))


def boosted(matches: DataFrame, recent: DataFrame | None = None, context_paths: list[str] = (), type_index: DataFrame | None = None) -> DataFrame:
    """matches whose score counts how near they lie to the context paths, how lately they were changed, and whether they
    define the type that they name. Where they stood among all matches is not counted yet."""
    score = F.coalesce(F.col("score"), F.lit(0.0))
    if context_paths:
        score = score + F.lit(40) * F.greatest(F.lit(0), *[P.shared_depth(F.col("path"), P.normalised(c)) for c in context_paths])
    rows = matches
    if recent is not None:
        rows = rows.join(recent.where(F.col("rank") < RECENT).select("path", F.col("rank").alias("_recent")), "path", "left")
        score = score + F.coalesce(F.lit(RECENT) - F.col("_recent"), F.lit(0))
    if type_index is not None:
        rows = rows.withColumn("_name", F.regexp_extract(F.coalesce("match_text", F.lit("")), "\\b[A-Z]\\w*", 0))
        defined = type_index.select(F.col("type_name").alias("_name"), "path", F.lit(2000).alias("_defines")).distinct()
        rows = rows.join(defined, ["_name", "path"], "left")
        score = score + F.coalesce("_defines", F.lit(0))
    return rows.withColumn("score", score.cast("double")).drop("_recent", "_name", "_defines")


def ranked(matches: DataFrame, recent: DataFrame | None = None, context_paths: list[str] = (), type_index: DataFrame | None = None) -> DataFrame:
    """matches with score and `rank` (from 1): what matched best, stood first, and is boosted(). matches has `position`,
    its place in the input, from 0."""
    rows = boosted(matches, recent, context_paths, type_index).withColumn("score", F.col("score") + F.greatest(F.lit(0), F.lit(FIRST) - F.col("position")))
    return ordering.numbered(rows, [F.desc("score"), "path", "line"], "rank", first=1).withColumn("rank", F.col("rank").cast("int"))


def file_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("path").agg(F.count(F.lit(1)).alias("count"))


def shaped(matches: DataFrame, max_results: int, max_chars: int) -> DataFrame:
    """The first max_results ranked rows, less those with which the kept ones would exceed max_chars as JSON."""
    fields = [c for c in matches.columns if c != "rank"]
    rows = matches.withColumn("_chars", F.char_length(F.to_json(F.struct(*fields))))
    # a JSON list has two brackets, and a comma before each further row
    return budget.choose(rows, ["rank"], "_chars", max_chars - 2, max_results, separator=1).drop("_chars", "position")


def summary(matches: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: limit_hit, omitted_total and a suggestion where rows were left out."""
    both = matches.agg(F.count(F.lit(1)).alias("n")).crossJoin(kept.agg(F.count(F.lit(1)).alias("k")))  # one row each
    left = F.col("n") - F.col("k")
    return both.select((left > 0).alias("limit_hit"), left.alias("omitted_total"), F.when(left > 0, F.lit(_TOO_MANY)).alias("suggestion"))


def slice_ends(files: DataFrame) -> list[str]:
    """Paths at which slices of about as many files end, in byte order; the last slice ends nowhere. They are taken from
    the paths with the least hashes: each task hands over SLICES * SAMPLED paths at most, and no content is read."""
    least = files.where("path IS NOT NULL").select("path", F.xxhash64("path").alias("_hash")).orderBy("_hash", "path").limit(SLICES * SAMPLED)
    sample = sorted((r["path"] for r in least.select("path").collect()), key=str.encode)
    return sample[SAMPLED - 1 :: SAMPLED]


def _between(rows: DataFrame, after: str | None, until: str | None) -> DataFrame:
    """Rows whose path lies in the range; the filter goes down to the scan where path is a column of it."""
    if after is not None:
        rows = rows.where(F.col("path") > after)
    return rows if until is None else rows.where(F.col("path") <= until)


def first_matches(files: DataFrame, query: str, max_results: int, shown_bytes: int = SHOWN_BYTES, **how) -> tuple[DataFrame, bool]:
    """The first max_results content matches by path and line, and whether there are more.

    Slices of the paths are searched in growing steps, and what lies behind the last match that is asked for is not read
    (but for the slice it is in). A step brings the places and sizes of at most max_results + 1 matches to the driver;
    the matches themselves are a plan over the files up to the last place. Once the matched texts and context exceed
    shown_bytes, the match that exceeds them is the last. how: as for content_matches(). Files without a path are passed over.
    """
    files = files.where("path IS NOT NULL")
    if max_results < 1:
        raise ValueError("a search asks for at least one match")
    cost = F.octet_length("match_text").cast("long")
    for side in ("context_before", "context_after") if how.get("around") is not None else ():
        cost = cost + F.aggregate(side, F.lit(0).cast("long"), lambda n, line: n + F.octet_length(line))
    ends: list[str | None] = [*slice_ends(files), None]
    places: list[Row] = []
    shown, done, step, after = 0, 0, 1, None
    while done < len(ends) and len(places) <= max_results and shown <= shown_bytes:
        done = min(len(ends), done + step)
        until = ends[done - 1]
        hits = content_matches(_between(files, after, until), query, **how).select("path", "line", cost.alias("cost"))
        for place in hits.orderBy("path", "line").limit(max_results + 1 - len(places)).collect():
            places.append(place)
            shown += place["cost"]
        after, step = until, step * GROWTH
    kept, used = 0, 0
    while kept < min(max_results, len(places)) and used <= shown_bytes:
        used += places[kept]["cost"]
        kept += 1
    # the bytes may be spent by the last match of a step, with no place known behind it
    more = kept < len(places) or (done < len(ends) and not content_matches(_between(files, after, None), query, **how).isEmpty())
    if not kept:
        return content_matches(files.limit(0), query, **how), False
    first, last = places[0]["path"], places[kept - 1]
    near = files.where((F.col("path") >= first) & (F.col("path") <= last["path"]))
    return content_matches(near, query, **how).where((F.col("path") < last["path"]) | (F.col("line") <= last["line"])), more


def found(files: DataFrame, query: str, mode: str = "auto", regex: bool = False, whole_word: bool = False, paths: list[str] = (), extensions: list[str] = (), exclude: list[str] = (), context_lines: int = 0, held: DataFrame | None = None) -> DataFrame:
    """All matches by path and by content, unranked, with their context; _branch is 0 for paths and 1 for contents. held:
    the content matches, where they are known already."""
    mode = resolve_mode(query, mode)
    files = narrowed(files, paths, extensions, exclude)
    none = F.array().cast("array<string>")
    branches = []
    if mode in ("path", "both"):
        named = path_matches(files, query, 0.15 if mode == "path" else 0.35)
        branches.append(named.select("path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("match_text"), none.alias("context_before"), none.alias("context_after"), F.lit("path").alias("kind"), "score", F.lit(0).alias("_branch")))
    if mode in ("content", "both"):
        if held is None:
            held = content_matches(searchable(files), query, regex, whole_word, around=context_lines or None)
        if not context_lines:
            held = held.withColumns({"context_before": none, "context_after": none})
        branches.append(held.select("path", "line", "col", "match_text", "context_before", "context_after", F.lit("content").alias("kind"), F.lit(0.0).alias("score"), F.lit(1).alias("_branch")))
    return branches[0] if len(branches) == 1 else branches[0].unionByName(branches[1])


def best(matches: DataFrame, recent: DataFrame | None = None, context_paths: list[str] = (), type_index: DataFrame | None = None, max_results: int = 50) -> DataFrame:
    """The best max_results of found() matches with rank. All of them are scored.

    Only the first FIRST matches are worth more for where they stand. So the best ones are among these and the best of
    all by the other scores: two top-k passes, in which no match is shuffled that a task does not hold for one of the best.
    """
    place = ["_branch", F.desc("_own"), "path", "line"]
    rows = boosted(matches.withColumn("_own", F.col("score")), recent, context_paths, type_index)
    first = _placed(rows, place, FIRST, "_at", 0).withColumn("score", F.col("score") + (F.lit(FIRST) - F.col("_at"))).drop("_at")
    others = rows.orderBy(F.desc("score"), "path", "line").limit(max_results + FIRST)
    # a match that is in both has its higher score among the first
    whole = [c for c in rows.columns if c not in ("_branch", "path", "line", "score")]
    both = first.unionByName(others).groupBy("_branch", "path", "line").agg(F.max("score").alias("score"), *[F.first(c).alias(c) for c in whole])
    return _placed(both, [F.desc("score"), "path", "line"], max_results, "rank", 1).drop("_branch", "_own")


def search(
    files: DataFrame, query: str, mode: str = "auto", regex: bool = False, whole_word: bool = False, paths: list[str] = (), extensions: list[str] = (), exclude: list[str] = (),
    context_lines: int = 0, context_paths: list[str] = (), recent: DataFrame | None = None, type_index: DataFrame | None = None, max_results: int = 50, max_chars: int = MAX_CHARS,
    stop_early: bool = False,
) -> DataFrame:
    """The best max_results matches with rank, by path and by content, as far as max_chars of JSON go. All matches are
    scored before the limit, with stop_early those by path and the first_matches() by content. A file's path is its key."""
    held = _first_held(files, query, mode, regex, whole_word, paths, extensions, exclude, context_lines, max_results)[0] if stop_early else None
    matches = found(files, query, mode, regex, whole_word, paths, extensions, exclude, context_lines, held)
    return shaped(best(matches, recent, context_paths, type_index, max_results), max_results, max_chars).select("rank", *MATCH)


def _first_held(files: DataFrame, query: str, mode: str, regex: bool, whole_word: bool, paths: list[str], extensions: list[str], exclude: list[str], context_lines: int, max_results: int) -> tuple[DataFrame | None, bool]:
    """first_matches() of a search, and none where contents are not searched."""
    if resolve_mode(query, mode) == "path":
        return None, False
    return first_matches(searchable(narrowed(files, paths, extensions, exclude)), query, max_results, regex=regex, whole_word=whole_word, around=context_lines or None)


def answer(files: DataFrame, query: str, stop_early: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """search() and, beside it, one row with limit_hit, omitted_total and a suggestion. They are counted over all matches;
    with stop_early contents behind the last match are not read: limit_hit says whether there are any, and omitted_total
    is null then, since nobody has counted them."""
    narrow = {k: v for k, v in options.items() if k in ("mode", "regex", "whole_word", "paths", "extensions", "exclude")}
    if not stop_early:
        kept = search(files, query, **options)
        return kept, summary(found(files, query, **narrow), kept)
    all_narrow = {"mode": "auto", "regex": False, "whole_word": False, "paths": (), "extensions": (), "exclude": ()} | narrow
    held, more = _first_held(files, query, *all_narrow.values(), options.get("context_lines", 0), options.get("max_results", 50))
    matches = found(files, query, **narrow, context_lines=options.get("context_lines", 0), held=held)
    ranking = {k: v for k, v in options.items() if k in ("recent", "context_paths", "type_index", "max_results")}
    kept = shaped(best(matches, **ranking), options.get("max_results", 50), options.get("max_chars", MAX_CHARS)).select("rank", *MATCH)
    told = summary(matches, kept)
    return kept, _uncounted(told) if more else told


def _uncounted(told: DataFrame) -> DataFrame:
    return told.select(F.lit(True).alias("limit_hit"), F.lit(None).cast("long").alias("omitted_total"), F.lit(_TOO_MANY).alias("suggestion"))
