"""Registered queries of the library's own operators, over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators import budget, edits, intervals, ordering, packaging, read, search, selection, structure, tree
from lodestone.plans.tables import commits, files, page_paths, ranges, selected, table
from lodestone.sources import corpus, vcs, versions

#: Tokens of a session when the whole selection is packaged.
BUNDLE_TOKENS = 160_000
#: Tokens of a part of a file map.
MAP_TOKENS = 2_000
#: Characters of a normalised line that edit_normalize shows; edits compare whole lines.
LINE_HEAD = 150
#: Rows of a table that one part of a shuffle may hold, where the number of parts follows the input.
PART_ROWS = 500_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The views that the SQL starts from.
_FILES = "f AS (SELECT concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'und'), doc_id || '.txt') AS path, coalesce(text, '') AS content FROM documents)"
_TOKENS = "CAST(ceil(ceil(strlen({0}) / 4.0 * 1.05::DOUBLE) * (CASE WHEN length({0}) / (length({0}) - length(replace({0}, chr(10), '')) + 1) > 100 AND (length({0}) - length(replace({0}, ';', ''))) > length({0}) * 0.01::DOUBLE THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)) AS BIGINT)"
_LINES = "l AS (SELECT path, content, unnest(generate_series(1, len(p))) AS line_no, unnest(p) AS line FROM (SELECT path, content, CASE WHEN content LIKE '%' || chr(10) THEN list_slice(string_split(content, chr(10)), 1, -2) ELSE string_split(content, chr(10)) END AS p FROM f))"


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# Catalog


def _number() -> Column:
    """The number in a document's path."""
    return F.split_part(F.split_part("path", F.lit("/"), F.lit(-1)), F.lit("."), F.lit(1)).cast("long")


_NUMBERED = "n AS (SELECT path, content, CAST(split_part(split_part(path, '/', -1), '.', 1) AS BIGINT) AS i FROM f)"


@query(
    "catalog_scan",
    f"""WITH {_FILES}, {_NUMBERED}, p AS (SELECT path, CASE WHEN i % 11 = 0 THEN 'a' || chr(0) || content WHEN i % 7 = 0 THEN 'n = 10' || chr(10) || 'stop' || chr(10) || content WHEN i % 5 = 0 THEN content || chr(0) ELSE content END AS content FROM n)
    SELECT path, CAST(strlen(content) AS BIGINT) AS size, strlen(content) > 100000 AS oversized, contains(content, chr(0)) AND strlen(split_part(content, chr(0), 1)) < 8192 AS is_binary FROM p""",
)
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of all files. Some begin with a NUL byte, some end with one, some have lines whose bytes only look like one."""
    text = F.when(F.col("i") % 11 == 0, F.concat(F.lit("a\x00"), "content")).when(F.col("i") % 7 == 0, F.concat(F.lit("n = 10\nstop\n"), "content")).when(F.col("i") % 5 == 0, F.concat("content", F.lit("\x00"))).otherwise(F.col("content"))
    rows = files(spark, sf_dir).withColumn("i", _number()).withColumn("content", text).withColumn("size", T.utf8_bytes("content"))
    return corpus.flagged(rows, size_cap=100_000).select("path", "size", "oversized", "is_binary")


@query(
    "generated_flag",
    f"""WITH {_FILES}, s AS (SELECT path, list_filter(list_slice(string_split(left(content, 8192), chr(10)), 1, 50), lambda x: length(trim(x)) > 0) AS ls FROM f)
    SELECT path, coalesce(list_sum(list_transform(ls, lambda x: length(x))) / nullif(len(ls), 0) > 300, false) AS likely_generated FROM s""",
)
def generated_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", corpus.likely_generated("path", "content").alias("likely_generated"))


_NAMES = ["ts", "js", "mjs", "py", "go", "rs", "swift", "java", "c", "h", "cpp", "cs", "rb", "php", "dart", "md", "txt"]


@query(
    "language_map",
    f"""WITH p AS (SELECT page_id, 'src/file' || page_id || '.' || list_extract({_NAMES}, CAST(page_id % 17 + 1 AS INTEGER)) AS path FROM pages), e AS (SELECT *, regexp_extract(path, '[.]([^.]*)$', 1) AS x FROM p)
    SELECT path, CASE x WHEN 'ts' THEN 'ts' WHEN 'js' THEN 'js' WHEN 'mjs' THEN 'js' WHEN 'py' THEN 'py' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'swift' THEN 'swift' WHEN 'java' THEN 'java'
      WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cs' THEN 'c_sharp' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' WHEN 'dart' THEN 'dart' END AS language FROM e""",
)
def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _NAMES))
    path = F.concat(F.lit("src/file"), F.col("page_id").cast("string"), F.lit("."), F.get(names, (F.col("page_id") % 17).cast("int")))
    return table(spark, sf_dir, "pages").select(path.alias("path")).select("path", P.language("path").alias("language"))


@query(
    "ignore_rules",
    r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
    SELECT path, CASE WHEN regexp_matches(path, '/en/[0-9]*7$') THEN false WHEN regexp_matches(path, '^[^/]*[.]org(/|$)') OR regexp_matches(path, '(^|/)fr(/|$)') OR regexp_matches(path, '/en/') THEN true ELSE false END AS ignored FROM p WHERE path <> ''""",
)
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["# comment", "*.org", "fr", "**/en/**", "!**/en/*7"]
    return page_paths(spark, sf_dir).select("path", P.ignored("path", rules).alias("ignored"))


@query("directories", f"WITH {_FILES} SELECT DISTINCT split_part(path, '/', 1) AS path FROM f UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM f")
def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.directories(files(spark, sf_dir))


@query("freshness", f"WITH {_FILES}, b AS (SELECT path, CAST(strlen(content) AS DOUBLE) AS m, CAST(split_part(split_part(path, '/', 3), '.', 1) AS BIGINT) AS i FROM f), n AS (SELECT path, CASE WHEN i % 5 = 1 THEN m + 1 ELSE m END AS c FROM b WHERE i % 7 <> 0) SELECT b.path, coalesce(m = c, false) AS fresh, c AS current_mtime_ms FROM b LEFT JOIN n ON b.path = n.path")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.split_part(F.split_part("path", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).cast("long")
    before = files(spark, sf_dir).select("path", F.col("size").cast("double").alias("mtime_ms"), number.alias("i"))
    now = before.where("i % 7 <> 0").withColumn("mtime_ms", F.when(F.col("i") % 5 == 1, F.col("mtime_ms") + 1).otherwise(F.col("mtime_ms")))
    return corpus.freshness(before, now)


@query(
    "catalog_delta",
    f"WITH {_FILES}, {_NUMBERED} SELECT path, CASE WHEN i % 5 = 0 THEN 'added' WHEN i % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM n WHERE (i % 5 <> 0 OR i % 7 <> 0) AND (i % 5 = 0 OR i % 7 = 0 OR i % 3 = 0)",
)
def catalog_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two snapshots of all files: some are new, some gone, some have another content."""
    rows = files(spark, sf_dir).select("path", "content", _number().alias("i"))
    before = rows.where("i % 5 <> 0").select("path", F.sha2("content", 256).alias("stamp"))
    now = rows.where("i % 7 <> 0").select("path", F.sha2(F.when(F.col("i") % 3 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("stamp"))
    return versions.changes(before, now).select("path", "change")


@query(
    "catalog_follow",
    f"WITH {_FILES}, {_NUMBERED}, e AS (SELECT path, content || CASE WHEN i % 3 = 0 THEN ' more' ELSE '' END || CASE WHEN i % 5 = 0 THEN '!' ELSE '' END AS t FROM n WHERE i % 7 <> 0) SELECT path, {_TOKENS.format('t')} AS tokens FROM e",
)
def catalog_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all files in a versioned table that follows three states of them; each time only what changed is measured."""
    kept = versions.Versioned(spark, ordering.work_folder(spark, "catalog-follow"), "path string, tokens long")
    rows = files(spark, sf_dir).select("path", "content", _number().alias("i"))
    longer = rows.where("i % 7 <> 0").withColumn("content", F.when(F.col("i") % 3 == 0, F.concat("content", F.lit(" more"))).otherwise(F.col("content")))
    for state in (rows, longer, longer.withColumn("content", F.when(F.col("i") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))):
        kept.follow(state.withColumn("stamp", F.sha2("content", 256)), lambda fresh: fresh.select("path", T.estimate_tokens("content").alias("tokens")))
    return kept.read()


# Tokens and filters


@query("token_estimate", f"SELECT doc_id, {_TOKENS.format('t')} AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(
    "token_estimate_cjk",
    f"""WITH {_FILES}, {_NUMBERED}, t AS (SELECT path, content || repeat('漢かカ한', CAST(i % 40 * 10 AS INTEGER)) AS t FROM n), k AS (SELECT *, length(t) - length(regexp_replace(t, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]', '', 'g')) AS cjk, length(t) / (length(t) - length(replace(t, chr(10), '')) + 1) > 100 AND (length(t) - length(replace(t, ';', ''))) > length(t) * 0.01::DOUBLE AS small FROM t)
    SELECT path, CAST(ceil(ceil(strlen(t) / 4.0 * 1.05::DOUBLE) * (CASE WHEN length(t) > 0 AND cjk > length(t) * 0.1::DOUBLE THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN small THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)) AS BIGINT) AS tokens FROM k""",
)
def token_estimate_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which more or less is Han, kana or Hangul."""
    rows = files(spark, sf_dir).withColumn("i", _number())
    return rows.select("path", T.estimate_tokens(F.concat("content", F.repeat(F.lit("漢かカ한"), (F.col("i") % 40 * 10).cast("int")))).alias("tokens"))


@query("line_density", "SELECT doc_id, CAST(length(t) AS DOUBLE) / (length(t) - length(replace(t, chr(10), '')) + 1) AS mean_line, length(t) / (length(t) - length(replace(t, chr(10), '')) + 1) > 100 AND (length(t) - length(replace(t, ';', ''))) > length(t) * 0.01 AS minified FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def line_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", (T.utf16_length(t) / (F.regexp_count(t, F.lit("\n")) + 1)).alias("mean_line"), T.is_minified(t).alias("minified"))


@query("filter_paths", f"WITH {_FILES} SELECT path FROM f WHERE path LIKE 'src1/%' OR path LIKE 'src3/en/%' OR path = 'src0/fr/0.txt'")
def filter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(P.under("path", ["src1/", "./src3/en", "src0/fr/0.txt"])).select("path")


@query("filter_extension", f"WITH {_FILES} SELECT path FROM f WHERE path LIKE '%7.txt' OR path LIKE '%3.txt'")
def filter_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(P.with_extension("path", ["7.txt", "3.txt"])).select("path")


@query("filter_exclude", f"WITH {_FILES} SELECT path FROM f WHERE NOT contains(path, '/de/') AND NOT contains(path, 'src1')")
def filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(P.not_excluded("path", ["*/de/*", "src1*"])).select("path")


# Search


@query("search_literal", f"WITH {_FILES}, {_LINES} SELECT path, CAST(line_no AS INTEGER) AS line, CAST(strlen(left(line, instr(line, 'license') - 1)) + 1 AS INTEGER) AS col, 'license' AS match_text FROM l WHERE contains(line, 'license')")
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.content_matches(files(spark, sf_dir), "license")


@query("search_regex", f"WITH {_FILES}, {_LINES}, m AS (SELECT *, regexp_extract(line, '[Tt]h[aeiou]+nd') AS t FROM l WHERE regexp_matches(line, '[Tt]h[aeiou]+nd')) SELECT path, CAST(line_no AS INTEGER) AS line, CAST(strlen(left(line, instr(line, t) - 1)) + 1 AS INTEGER) AS col, t AS match_text FROM m")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.content_matches(files(spark, sf_dir), "[Tt]h[aeiou]+nd", regex=True)


@query("search_word", f"WITH {_FILES}, {_LINES} SELECT path, CAST(line_no AS INTEGER) AS line, 'License' AS match_text FROM l WHERE regexp_matches(line, '\\bLicense\\b')")
def search_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.content_matches(files(spark, sf_dir), "License", whole_word=True).select("path", "line", "match_text")


@query(
    "search_context",
    f"""WITH {_FILES}, {_LINES}, h AS (SELECT path, line_no FROM l WHERE contains(line, 'License')),
    c AS (SELECT l.path, l.line_no, l.line, min(h.line_no) FILTER (h.line_no > l.line_no AND h.line_no - l.line_no <= 2) AS nxt, max(h.line_no) FILTER (h.line_no < l.line_no AND l.line_no - h.line_no <= 2) AS prv
          FROM l JOIN h ON l.path = h.path AND abs(l.line_no - h.line_no) <= 2 GROUP BY ALL),
    d AS (SELECT c.* FROM c LEFT JOIN h ON c.path = h.path AND c.line_no = h.line_no WHERE h.path IS NULL),
    o AS (SELECT path, coalesce(nxt, prv) AS line, list(line ORDER BY line_no) FILTER (nxt IS NOT NULL) AS b, list(line ORDER BY line_no) FILTER (nxt IS NULL) AS a FROM d GROUP BY 1, 2)
    SELECT h.path, CAST(h.line_no AS INTEGER) AS line, coalesce(b, []) AS context_before, coalesce(a, []) AS context_after FROM h LEFT JOIN o ON h.path = o.path AND h.line_no = o.line""",
)
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.content_matches(files(spark, sf_dir), "License", around=2).select("path", "line", "context_before", "context_after")


_PAGES = "p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


@query(
    "search_path_fuzzy",
    f"""WITH {_PAGES}, g AS (SELECT path, list_distinct(list_transform(generate_series(1, length(n) - 1), lambda i: substr(n, i, 2))) AS s FROM (SELECT path, regexp_replace(lower(path), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS n FROM p WHERE path <> '')),
    q AS (SELECT ['ex', 'xa', 'am', 'mp', 'pl', 'le', 'ef', 'fr'] AS w), d AS (SELECT path, 2.0 * len(list_intersect(w, s)) / (len(w) + len(s)) AS dice FROM g, q)
    SELECT path, CASE WHEN contains(lower(path), 'example fr') THEN 500 ELSE dice * 400 END AS score FROM d WHERE dice >= 0.35""",
)
def search_path_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.path_matches(page_paths(spark, sf_dir), "example fr", 0.35)


@query("recency_rank", "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (ORDER BY ts DESC, event_id) AS pos FROM events), m AS (SELECT path, min(pos) AS pos FROM e GROUP BY 1) SELECT path, CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS rank FROM m")
def recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recency(commits(spark, sf_dir))


@query("file_counts", f"WITH {_FILES}, {_LINES} SELECT path, count(*) AS count FROM l WHERE contains(line, 'that') GROUP BY 1")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_counts(search.content_matches(files(spark, sf_dir), "that"))


@query(
    "search_rank",
    f"""WITH {_FILES}, {_LINES}, m AS (SELECT path, CAST(line_no AS INTEGER) AS line, row_number() OVER (ORDER BY path, line_no) - 1 AS position FROM l WHERE contains(line, 'License')),
    t AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS r FROM (SELECT DISTINCT path FROM m)),
    s AS (SELECT m.path, line, CAST(greatest(0, 1000 - position) + 40 * CASE WHEN m.path = 'src1/en/1.txt' THEN 3 WHEN m.path LIKE 'src1/en/%' THEN 2 WHEN m.path LIKE 'src1/%' THEN 1 ELSE 0 END + greatest(0, 200 - r) AS DOUBLE) AS score FROM m JOIN t ON m.path = t.path)
    SELECT path, line, score, CAST(row_number() OVER (ORDER BY score DESC, path, line) AS INTEGER) AS rank FROM s""",
)
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.content_matches(files(spark, sf_dir), "License")
    placed = ordering.numbered(hits.withColumn("score", F.lit(0.0)), ["path", "line"], "position").withColumn("position", F.col("position").cast("int"))
    recent = search.recency(hits.select("path", F.col("path").alias("pos")))
    return search.ranked(placed, recent, ["src1/en/1.txt"]).select("path", "line", "score", "rank")


_HITS = """h AS (SELECT path, line_no, line FROM l WHERE contains(line, 'License'))"""


@query(
    "search_top",
    f"""WITH {_FILES}, {_LINES}, {_NUMBERED}, {_HITS}, m AS (SELECT path, CAST(line_no AS INTEGER) AS line, CAST(strlen(left(line, instr(line, 'License') - 1)) + 1 AS INTEGER) AS col, row_number() OVER (ORDER BY path, line_no) - 1 AS position FROM h),
    r AS (SELECT path, row_number() OVER (ORDER BY i DESC, path) - 1 AS r FROM n),
    s AS (SELECT m.path, line, col, CAST(greatest(0, 1000 - position) + 40 * CASE WHEN m.path = 'src1/en/1.txt' THEN 3 WHEN m.path LIKE 'src1/en/%' THEN 2 WHEN m.path LIKE 'src1/%' THEN 1 ELSE 0 END + greatest(0, 200 - r) AS DOUBLE) AS score FROM m JOIN r ON m.path = r.path),
    k AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, path, line) AS INTEGER) AS rank FROM s QUALIFY rank <= 50),
    c AS (SELECT l.path, l.line_no, l.line, min(h.line_no) FILTER (h.line_no > l.line_no) AS nxt, max(h.line_no) FILTER (h.line_no < l.line_no) AS prv FROM l JOIN h ON l.path = h.path AND abs(l.line_no - h.line_no) = 1 GROUP BY ALL),
    d AS (SELECT c.* FROM c ANTI JOIN h ON c.path = h.path AND c.line_no = h.line_no),
    o AS (SELECT path, coalesce(nxt, prv) AS line, list(line ORDER BY line_no) FILTER (nxt IS NOT NULL) AS b, list(line ORDER BY line_no) FILTER (nxt IS NULL) AS a FROM d GROUP BY 1, 2)
    SELECT rank, k.path, k.line, col, 'License' AS match_text, coalesce(b, []) AS context_before, coalesce(a, []) AS context_after, 'content' AS kind, score FROM k LEFT JOIN o ON k.path = o.path AND k.line = o.line""",
)
def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole search: the best 50 matches by path and content with context. The latest documents count as changed last."""
    rows = files(spark, sf_dir)
    recent = search.recency(rows.select("path", (-_number()).alias("pos")), top=search.RECENT)
    return search.search(rows, "License", context_lines=1, context_paths=["src1/en/1.txt"], recent=recent, max_chars=1_000_000)


@query("search_first", f"WITH {_FILES}, {_LINES} SELECT path, CAST(line_no AS INTEGER) AS line, CAST(strlen(left(line, instr(line, 'the') - 1)) + 1 AS INTEGER) AS col, 'the' AS match_text FROM l WHERE contains(line, 'the') ORDER BY path, line_no LIMIT 200")
def search_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 matches by path and line, of a search that stops once it has them."""
    return search.first_matches(files(spark, sf_dir), "the", 200)[0]


@query(
    "search_shape",
    f"""WITH {_FILES}, {_LINES}, {_HITS}, m AS (SELECT path, line_no, strlen(left(line, instr(line, 'License') - 1)) + 1 AS col, row_number() OVER (ORDER BY path, line_no) AS rank FROM h QUALIFY rank <= 40),
    x AS (SELECT rank, CAST(length('{{"path":"","line":,"col":,"match_text":"License"}}') + length(path) + length(CAST(line_no AS VARCHAR)) + length(CAST(col AS VARCHAR)) AS BIGINT) AS c FROM m),
    a AS (SELECT list({{'c': c, 'k': rank, 'used': 0::BIGINT, 'ks': []::BIGINT[]}} ORDER BY rank) AS xs FROM x),
    r AS (SELECT list_reduce(list_prepend({{'c': 0::BIGINT, 'k': 0::BIGINT, 'used': 0::BIGINT, 'ks': []::BIGINT[]}}, xs), lambda s, x: CASE WHEN s.used + x.c + CASE WHEN len(s.ks) > 0 THEN 1 ELSE 0 END <= 998 THEN {{'c': 0::BIGINT, 'k': 0::BIGINT, 'used': s.used + x.c + CASE WHEN len(s.ks) > 0 THEN 1 ELSE 0 END, 'ks': list_append(s.ks, x.k)}} ELSE s END) AS s FROM a)
    SELECT m.path, CAST(m.line_no AS INTEGER) AS line, CAST(m.rank AS INTEGER) AS rank FROM m, r WHERE list_contains(s.ks, m.rank)""",
)
def search_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 matches as far as 1,000 characters of JSON go."""
    hits = search.content_matches(files(spark, sf_dir), "License")
    return search.shaped(ordering.numbered(hits, ["path", "line"], "rank", first=1).withColumn("rank", F.col("rank").cast("int")), 40, 1000).select("path", "line", "rank")


@query(
    "budget_groups",
    """WITH g AS (SELECT o_custkey % 20 AS g, o_orderkey, CAST(strlen(o_orderpriority) * 7 + o_orderkey % 90 AS BIGINT) AS cost, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS position FROM orders),
    a AS (SELECT g, list({'p': position, 'k': o_orderkey, 'c': cost} ORDER BY position) AS xs FROM g WHERE position <= 40 GROUP BY 1),
    r AS (SELECT g, list_reduce(xs, lambda s, x: CASE WHEN s.used + x.c <= 900 THEN {'used': s.used + x.c, 'ks': list_append(s.ks, x.k)} ELSE s END, {'used': 0::BIGINT, 'ks': []::BIGINT[]}) AS s FROM (SELECT g, list_transform(xs, lambda x: {'used': 0::BIGINT, 'ks': []::BIGINT[], 'c': x.c, 'k': x.k}) AS xs FROM a))
    SELECT g, unnest(s.ks) AS o_orderkey FROM r""",
)
def budget_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice under a budget, for each of twenty groups."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("g"), "o_orderkey", (F.octet_length("o_orderpriority") * 7 + F.col("o_orderkey") % 90).cast("long").alias("cost"))
    return budget.choose(rows, ["o_orderkey"], "cost", 900, 40, group=["g"]).select("g", "o_orderkey")


# Read


@query("read_slice", f"WITH {_FILES}, {_LINES}, c AS (SELECT path, string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no BETWEEN 2 AND 4) AS s, max(line_no) AS n, max(content) AS content FROM l GROUP BY 1) SELECT path, sha256(coalesce(s || CASE WHEN n > 4 OR content LIKE '%' || chr(10) THEN chr(10) ELSE '' END, '')) AS slice_sha256, CAST(n AS INTEGER) AS total_lines, CAST(least(4, n) AS INTEGER) AS last_line FROM c")
def read_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.slice_lines(files(spark, sf_dir).where("content <> ''"), 2, 3).select("path", F.sha2("slice", 256).alias("slice_sha256"), "total_lines", F.least(F.lit(4), "last_line").alias("last_line"))


@query("read_tail", f"WITH {_FILES}, {_LINES}, n AS (SELECT path, max(line_no) AS n, max(content) AS content FROM l GROUP BY 1), c AS (SELECT l.path, string_agg(line, chr(10) ORDER BY line_no) AS s, min(line_no) AS a, max(n.content) AS content FROM l JOIN n ON l.path = n.path WHERE line_no > n - 2 GROUP BY 1) SELECT path, sha256(s || CASE WHEN content LIKE '%' || chr(10) THEN chr(10) ELSE '' END) AS slice_sha256, CAST(a AS INTEGER) AS first_line FROM c")
def read_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.slice_lines(files(spark, sf_dir).where("content <> ''"), -2).select("path", F.sha2("slice", 256).alias("slice_sha256"), "first_line")


@query("read_batch", f"WITH {_FILES}, r AS (SELECT CAST(page_id AS INTEGER) AS request_idx, 'src' || page_id % 20 || '/en/' || page_id || '.txt' AS path FROM pages), k AS (SELECT 200000 // count(*) AS share FROM r) SELECT request_idx, r.path, f.path IS NOT NULL AS found, left(content, CAST(share AS INTEGER)) AS text, CAST(coalesce(greatest(length(content) - share, 0), 0) AS BIGINT) AS omitted, coalesce(length(content) > share, false) AS truncated FROM r CROSS JOIN k LEFT JOIN f ON r.path = f.path")
def read_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "pages").select(F.col("page_id").cast("int").alias("request_idx"), F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string"), F.lit("/en/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("path"))
    return read.read_batch(asked, files(spark, sf_dir), 200_000)


@query("read_refusals", f"WITH {_FILES}, {_NUMBERED} SELECT path, CASE WHEN i % 11 = 0 THEN 'binary' WHEN strlen(content) > 3000 THEN 'too_large' END AS code FROM n")
def read_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("content", F.when(_number() % 11 == 0, F.concat(F.lit("\x00"), "content")).otherwise(F.col("content")))
    return corpus.flagged(rows, size_cap=3000).select("path", read.refusal()["code"].alias("code"))


# Trees

_PREFIXES = "x AS (SELECT DISTINCT path, unnest(generate_series(0, len(string_split(path, '/')))) AS depth FROM p WHERE path <> ''), y AS (SELECT path, depth, array_to_string(list_slice(string_split(path, '/'), 1, depth), '/') AS prefix, depth = len(string_split(path, '/')) AS leaf FROM x)"
_ROLLUP = f"{_PAGES}, {_PREFIXES}, a AS (SELECT prefix, depth, count(*) AS file_count, bool_or(leaf) AS is_leaf FROM y GROUP BY 1, 2), ds AS (SELECT prefix FROM a WHERE NOT is_leaf AND depth > 0), dc AS (SELECT a.prefix, count(*) AS dir_count FROM a JOIN ds ON ds.prefix <> a.prefix AND (a.prefix = '' OR starts_with(ds.prefix, a.prefix || '/')) GROUP BY 1), t AS (SELECT a.prefix, CAST(depth AS INTEGER) AS depth, CASE WHEN is_leaf THEN 'file' ELSE 'dir' END AS kind, file_count, coalesce(dir_count, 0) AS dir_count FROM a LEFT JOIN dc ON a.prefix = dc.prefix)"


@query("tree_rollup", f"WITH {_ROLLUP} SELECT * FROM t")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.rollup(page_paths(spark, sf_dir))


@query("tree_depth", f"WITH {_PAGES} SELECT CAST(max(len(string_split(path, '/'))) AS INTEGER) AS max_depth FROM p")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.max_depth(page_paths(spark, sf_dir))


@query("tree_anchors", f"WITH {_ROLLUP}, s AS (SELECT DISTINCT path FROM p WHERE path LIKE '%/en/1%'), m AS (SELECT prefix FROM t WHERE depth > 0 AND (prefix IN (SELECT path FROM s) OR (kind = 'dir' AND depth = 1))) SELECT t.prefix, t.prefix IN (SELECT path FROM s) AS selected, t.kind = 'dir' AND t.depth = 1 AS heuristic_anchor, EXISTS (SELECT 1 FROM m WHERE m.prefix <> t.prefix AND (t.prefix = '' OR starts_with(m.prefix, t.prefix || '/'))) AS anchor_descendant FROM t")
def tree_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = page_paths(spark, sf_dir)
    return tree.anchors(tree.rollup(paths), paths.where(F.col("path").rlike("/en/1"))).select("prefix", "selected", "heuristic_anchor", "anchor_descendant")


@query("tree_render")
def tree_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered tree of all page paths within 2,000 tokens, a row for each line."""
    paths = page_paths(spark, sf_dir)
    shown = tree.render(tree.anchors(tree.rollup(paths), paths.where(F.col("path").rlike("/en/1\\d?$"))), max_tokens=2000)
    return spark.range(1).select(F.posexplode(F.split(F.lit(shown["tree"]), "\n")).alias("line_no", "line"))


# Structure: a small code base made of suppliers, each a class that refers to another one's


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    other = F.floor(F.col("s_suppkey") / 2).cast("string")
    py = F.concat(F.lit("import os\nLIMIT = "), k, F.lit("\nclass Supplier"), k, F.lit("(Supplier"), other, F.lit("):\n    def name(self):\n        return os.name\n\ndef make"), k, F.lit("() -> Supplier"), other, F.lit(":\n    return None\n"))
    ts = F.concat(F.lit("import { x } from './x';\nexport class Supplier"), k, F.lit(" extends Supplier"), other, F.lit(" {\n  name(): string {\n    return 'n';\n  }\n}\nexport function make"), k, F.lit("(): Supplier"), other, F.lit(" {\n  return null;\n}\n"))
    is_py = F.col("s_suppkey") % 2 == 0
    path = F.concat(F.lit("src/supplier"), k, F.when(is_py, F.lit(".py")).otherwise(F.lit(".ts")))
    return table(spark, sf_dir, "supplier").select(path.alias("path"), F.when(is_py, py).otherwise(ts).alias("content"))


_SUPPLIERS = "s AS (SELECT CAST(s_suppkey AS BIGINT) AS k, 'src/supplier' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.ts' END AS path FROM supplier)"


@query(
    "codemap_extract",
    f"""WITH {_SUPPLIERS} SELECT path, 1 AS line_no, 'import' AS kind, CASE WHEN k % 2 = 0 THEN 'import os' ELSE '''./x''' END AS name, NULL AS container FROM s
    UNION ALL SELECT path, 2, 'var', 'LIMIT', NULL FROM s WHERE k % 2 = 0
    UNION ALL SELECT path, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END, 'class', 'Supplier' || k, NULL FROM s
    UNION ALL SELECT path, CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END, 'method', 'name', 'Supplier' || k FROM s
    UNION ALL SELECT path, 7, 'function', 'make' || k, NULL FROM s
    UNION ALL SELECT path, 2, 'export', 'export class Supplier' || k || ' extends Supplier' || (k // 2), NULL FROM s WHERE k % 2 = 1
    UNION ALL SELECT path, 7, 'export', 'export function make' || k || '(): Supplier' || (k // 2), NULL FROM s WHERE k % 2 = 1""",
)
def codemap_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.symbols(_code(spark, sf_dir)).select("path", "line_no", "kind", "name", "container")


_MAPS = f"""{_SUPPLIERS}, m AS (SELECT path, k, CASE WHEN k % 2 = 0
      THEN format('File: {{}}\nImports:\n  - import os\n---\n\nClasses:\n  - Supplier{{}}\n    Methods:\n      - L4: def name(self):\n\nFunctions:\n  - L7: def make{{}}() -> Supplier{{}}:\n\nGlobal vars:\n  - LIMIT\n---\n', path, k, k, k // 2)
      ELSE format('File: {{}}\nImports:\n  - ''./x''\n---\n\nClasses:\n  - Supplier{{}}\n    Methods:\n      - L3: name(): string\n\nFunctions:\n  - L7: export function make{{}}(): Supplier{{}}\n\nExports:\n  - export class Supplier{{}} extends Supplier{{}}\n  - export function make{{}}(): Supplier{{}}\n---\n', path, k, k, k // 2, k, k // 2, k, k // 2) END AS text FROM s)"""


@query("codemap_text", f"WITH {_MAPS} SELECT path, text FROM m")
def codemap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.codemaps(structure.symbols(_code(spark, sf_dir)))


@query("type_index", f"WITH {_SUPPLIERS} SELECT 'Supplier' || k AS type_name, path FROM s")
def type_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.type_index(structure.symbols(_code(spark, sf_dir)))


@query("type_index_follow", f"WITH {_SUPPLIERS} SELECT CASE WHEN k % 3 = 0 THEN 'Vendor' ELSE 'Supplier' END || k AS type_name, path FROM s WHERE k % 4 <> 1")
def type_index_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type index of a table of declarations after some files were changed and some removed."""
    kept = versions.Versioned(spark, ordering.work_folder(spark, "type-index-follow"), structure.SYMBOL)
    code = _code(spark, sf_dir).withColumn("k", F.regexp_extract("path", "(\\d+)", 1).cast("int"))
    renamed = code.where("k % 4 <> 1").withColumn("content", F.when(F.col("k") % 3 == 0, F.replace("content", F.lit("class Supplier"), F.lit("class Vendor"))).otherwise(F.col("content")))
    for state in (code, renamed):
        structure.keep(state.withColumn("stamp", F.sha2("content", 256)), kept)
    return structure.type_index(kept.read())


@query("type_references", f"WITH {_SUPPLIERS} SELECT path, 'Supplier' || (k // 2) AS type_name FROM s WHERE k // 2 <> k UNION SELECT path, 'LIMIT' FROM s WHERE k % 2 = 0")
def type_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.references(structure.symbols(_code(spark, sf_dir)))


@query("auto_closure", f"WITH {_SUPPLIERS}, c AS (SELECT * FROM s WHERE k % 3 = 0) SELECT DISTINCT 'one' AS session_id, d.path FROM c JOIN s d ON d.k = c.k // 2 WHERE d.path NOT IN (SELECT path FROM c)")
def auto_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    found = structure.symbols(code)
    explicit = code.where(F.regexp_extract("path", "(\\d+)", 1).cast("int") % 3 == 0).select(F.lit("one").alias("session_id"), "path", F.lit("full").alias("mode"))
    return selection.closure(explicit, structure.references(found), structure.type_index(found))


@query(
    "structure_budget",
    f"""WITH {_MAPS}, t AS (SELECT path, {_TOKENS.format("text")} AS cost FROM m WHERE path LIKE 'src/%'), a AS (SELECT list({{'path': path, 'cost': cost, 'n': 0, 'used': 0::BIGINT, 'kept': []::VARCHAR[]}} ORDER BY path) AS xs FROM (SELECT * FROM t ORDER BY path LIMIT 10)),
    r AS (SELECT list_reduce(list_prepend({{'path': '', 'cost': 0::BIGINT, 'n': 0, 'used': 0::BIGINT, 'kept': []::VARCHAR[]}}, xs), lambda s, x: CASE WHEN s.n = 0 OR s.used + x.cost <= 250 THEN {{'path': '', 'cost': 0::BIGINT, 'n': s.n + 1, 'used': s.used + x.cost, 'kept': list_append(s.kept, x.path)}} ELSE s END) AS s FROM a)
    SELECT unnest(s.kept) AS path FROM r""",
)
def structure_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structures of a folder's first ten files as far as 250 tokens go; the first is always taken."""
    return structure.structures(structure.codemaps(structure.symbols(_code(spark, sf_dir))), ["src"], 10, 250).select("path")


#: Files in each language, `#` standing for a number: its name, its text, and (line, kind, name, container, signature).
_LANGUAGES = [
    ("a#.ts", "import y from 'http://x/#';\nconst t = `\n{\n`;\nexport class Cart# extends Base {\n  total: number = 0;\n  add(item: Item): void {\n    const local = 1;\n  }\n}\nexport enum Kind# { A, B }\n",
     [(1, "import", "'http://x/#'", None, "import y from 'http://x/#';"), (2, "var", "t", None, "const t = ` { `;"), (5, "class", "Cart#", None, "export class Cart# extends Base"), (5, "export", "export class Cart# extends Base", None, "export class Cart# extends Base"), (6, "property", "total", "Cart#", "total: number = 0;"), (7, "method", "add", "Cart#", "add(item: Item): void"), (11, "enum", "Kind#", None, "export enum Kind#"), (11, "export", "export enum Kind#", None, "export enum Kind#")]),
    ("b#.js", "class Old# {\n  go() {\n    const re = /[{]/;\n  }\n}\nfunction start#() {\n}\n", [(1, "class", "Old#", None, "class Old#"), (2, "method", "go", "Old#", "go()"), (6, "function", "start#", None, "function start#()")]),
    ("c#.tsx", "// {\nexport function View#(props: Props) {\n  return null;\n}\n", [(2, "function", "View#", None, "export function View#(props: Props)"), (2, "export", "export function View#(props: Props)", None, "export function View#(props: Props)")]),
    ("d#.py", "class Dog#(Animal):\n  kind = 'd'\n  def bark(self, n: int) -> None:\n    local = 1\ndef main#(\n  a=1,\n):\n  pass\n", [(1, "class", "Dog#", None, "class Dog#(Animal):"), (2, "property", "kind", "Dog#", "kind = 'd'"), (3, "method", "bark", "Dog#", "def bark(self, n: int) -> None:"), (5, "function", "main#", None, "def main#( a=1, ):")]),
    ("e#.go", "type Box# struct {\n\tSize int\n}\nfunc (b *Box#) Grow(n int) {\n}\n", [(1, "class", "Box#", None, "type Box# struct"), (2, "property", "Size", "Box#", "Size int"), (4, "method", "Grow", "Box#", "func (b *Box#) Grow(n int)")]),
    ("f#.rs", "pub struct Point# {\n    x: i32,\n}\nimpl Point# {\n    pub fn len<'a>(&'a self) -> char {\n        '{'\n    }\n}\n", [(1, "class", "Point#", None, "pub struct Point#"), (2, "property", "x", "Point#", "x: i32,"), (4, "impl", "Point#", None, "impl Point#"), (5, "method", "len", "Point#", "pub fn len<'a>(&'a self) -> char")]),
    ("g#.swift", "protocol Named# {\n    func show()\n}\n#Preview { Card() }\n", [(1, "interface", "Named#", None, "protocol Named#"), (2, "method", "show", "Named#", "func show()"), (4, "preview", "#Preview", None, "#Preview")]),
    ("H#.java", "public class Shop# {\n    private int total;\n    public int sum(List<Item> xs) {\n        return total;\n    }\n}\n", [(1, "class", "Shop#", None, "public class Shop#"), (2, "property", "total", "Shop#", "private int total;"), (3, "method", "sum", "Shop#", "public int sum(List<Item> xs)")]),
    ("i#.c", "#define MAX# 3\nstruct node# {\n    int v;\n};\nint add#(int a, int b) {\n    return a + b;\n}\n", [(1, "macro", "MAX#", None, "#define MAX# 3"), (2, "class", "node#", None, "struct node#"), (3, "property", "v", "node#", "int v;"), (5, "function", "add#", None, "int add#(int a, int b)")]),
    ("j#.cpp", "namespace a\n{\nclass Engine#\n{\n    void start(int n);\n};\n}\n", [(3, "class", "Engine#", None, "class Engine#"), (5, "method", "start", "Engine#", "void start(int n);")]),
    ("K#.cs", "namespace N\n{\n    public class Room#\n    {\n        public void Open(int n)\n        {\n            var x = 1;\n        }\n    }\n}\n", [(3, "class", "Room#", None, "public class Room#"), (5, "method", "Open", "Room#", "public void Open(int n)")]),
    ("l#.rb", "module Outer#\n  class Inner#\n    def grow(n)\n    end\n  end\nend\n", [(1, "class", "Outer#", None, "module Outer#"), (2, "class", "Inner#", None, "class Inner#"), (3, "method", "grow", "Inner#", "def grow(n)")]),
    ("m#.php", "<?php\nclass Cart# {\n    public function add($x) {\n        return '{';\n    }\n}\nfunction run#($a) {\n}\n", [(2, "class", "Cart#", None, "class Cart#"), (3, "method", "add", "Cart#", "public function add($x)"), (7, "function", "run#", None, "function run#($a)")]),
    ("n#.dart", "class Car# {\n  int speed = 0;\n}\ntypedef Fn# = int;\n", [(1, "class", "Car#", None, "class Car#"), (2, "property", "speed", "Car#", "int speed = 0;"), (4, "alias", "Fn#", None, "typedef Fn# = int;")]),
    ("o#.ts", "import {\n  A#,\n  B,\n} from './m#';\nconst a = 1, b = f(1, 2);\nclass Z# {\n  static async z(\n    a: Widget#,\n    b: Gadget,\n  ): Promise<Thing> {\n    return a;\n  }\n  x = 1; y: Map<string, number>;\n}\n",
     [(1, "import", "'./m#'", None, "import { A#, B, } from './m#';"), (5, "var", "a", None, "const a = 1, b = f(1, 2);"), (5, "var", "b", None, "const a = 1, b = f(1, 2);"), (6, "class", "Z#", None, "class Z#"), (7, "method", "z", "Z#", "static async z( a: Widget#, b: Gadget, ): Promise<Thing>"), (13, "property", "x", "Z#", "x = 1;"), (13, "property", "y", "Z#", "y: Map<string, number>;")]),
    ("p#.go", "import (\n\t\"fmt\"\n)\ntype (\n\tA# struct {\n\t\tX, Y int\n\t}\n\tB# interface {\n\t\tRun(n int) error\n\t}\n)\nvar (\n\tv = 1\n)\nfunc (a A#) Go(\n\tn int,\n) error {\n\treturn nil\n}\n",
     [(2, "import", '"fmt"', None, 'import "fmt"'), (5, "class", "A#", None, "type A# struct"), (6, "property", "X", "A#", "X, Y int"), (6, "property", "Y", "A#", "X, Y int"), (8, "interface", "B#", None, "type B# interface"), (9, "method", "Run", "B#", "Run(n int) error"), (13, "var", "v", None, "var v = 1"), (15, "method", "Go", "A#", "func (a A#) Go( n int, ) error")]),
    ("q#.java", "@Deprecated\npublic class A# {\n  int a, b;\n  A#(int x) { this.x = x; }\n  int get() { return x; }\n  public <T> Map<String, T> of(\n      T a) { return null; }\n}\n",
     [(1, "class", "A#", None, "@Deprecated public class A#"), (3, "property", "a", "A#", "int a, b;"), (3, "property", "b", "A#", "int a, b;"), (4, "method", "A#", "A#", "A#(int x)"), (5, "method", "get", "A#", "int get()"), (6, "method", "of", "A#", "public <T> Map<String, T> of( T a)")]),
    ("r#.c", "typedef struct {\n  int x, y;\n} Point#;\ntypedef struct node# { int v; } Node#;\nint add#(int a,\n         int b) { return a + b; }\nstatic int n# = 0, m = 1;\n",
     [(1, "alias", "Point#", None, "typedef struct Point#;"), (2, "property", "x", "Point#", "int x, y;"), (2, "property", "y", "Point#", "int x, y;"), (4, "class", "node#", None, "typedef struct node#"), (4, "alias", "Node#", None, "typedef struct node# Node#;"), (4, "property", "v", "node#", "int v;"), (5, "function", "add#", None, "int add#(int a, int b)"), (7, "var", "n#", None, "static int n# = 0, m = 1;"), (7, "var", "m", None, "static int n# = 0, m = 1;")]),
    ("s#.cpp", "class E# : public Base\n{\npublic:\n  int size() const { return n; }\n  E#(int x) : n(x) {}\nprivate:\n  int n;\n};\n", [(1, "class", "E#", None, "class E# : public Base"), (4, "method", "size", "E#", "int size() const"), (5, "method", "E#", "E#", "E#(int x) : n(x)"), (7, "property", "n", "E#", "int n;")]),
    ("t#.py", "class A#:\n    class B:\n        hidden = 1\n        def no(self): pass\n    shown = 2\n    def yes(\n        self,\n    ) -> C#:\n        import os\nif shown:\n    import sys\n    def inner(): pass\nfrom m import (\n    a,\n)\n",
     [(1, "class", "A#", None, "class A#:"), (5, "property", "shown", "A#", "shown = 2"), (6, "method", "yes", "A#", "def yes( self, ) -> C#:"), (13, "import", "from m import ( a, )", None, "from m import ( a, )")]),
    ("u#.swift", "extension Card#: View {\n  func draw(\n    a: Int\n  ) -> Int { 1 }\n  var body: some View { Text(a) }\n}\nlet a = 1, b = 2\n", [(1, "class", "Card#", None, "extension Card#: View"), (2, "method", "draw", "Card#", "func draw( a: Int ) -> Int"), (5, "property", "body", "Card#", "var body: some View"), (7, "var", "a", None, "let a = 1, b = 2"), (7, "var", "b", None, "let a = 1, b = 2")]),
    ("v#.rb", "class T#\n  attr_reader :x, :y\n  def one(a) = a\n  def two; end\n  def three(a,\n            b)\n  end\nend\n", [(1, "class", "T#", None, "class T#"), (2, "property", "x", "T#", "attr_reader :x, :y"), (2, "property", "y", "T#", "attr_reader :x, :y"), (3, "method", "one", "T#", "def one(a) = a"), (4, "method", "two", "T#", "def two; end"), (5, "method", "three", "T#", "def three(a, b)")]),
    ("w#.php", "<?php\nuse App\\Base#;\nclass C# {\n  use Shared;\n  private $a = 1, $b;\n  function f(\n    $x\n  ) { return 1; }\n}\n", [(2, "import", "use App\\Base#;", None, "use App\\Base#;"), (3, "class", "C#", None, "class C#"), (5, "property", "a", "C#", "private $a = 1, $b;"), (5, "property", "b", "C#", "private $a = 1, $b;"), (6, "method", "f", "C#", "function f( $x )")]),
    ("x#.dart", "class C# {\n  int get y => 1;\n  final Map<String, int> m = {}; int a, b = 2;\n  void run(\n    int n,\n  ) { go(); }\n}\n", [(1, "class", "C#", None, "class C#"), (2, "method", "y", "C#", "int get y => 1;"), (3, "property", "m", "C#", "final Map<String, int> m = {};"), (3, "property", "a", "C#", "int a, b = 2;"), (3, "property", "b", "C#", "int a, b = 2;"), (4, "method", "run", "C#", "void run( int n, )")]),
    ("y#.rs", "#[derive(Debug)]\npub struct P# { x: i32, y: HashMap<u8, u8> }\nuse a::{\n    b,\n    c,\n};\nimpl<T> Show for P# {\n    fn f(\n        &self,\n    ) -> i32 { 1 }\n}\n", [(2, "class", "P#", None, "pub struct P#"), (2, "property", "x", "P#", "x: i32,"), (2, "property", "y", "P#", "y: HashMap<u8, u8>"), (3, "import", "use a::{ b, c, };", None, "use a::{ b, c, };"), (7, "impl", "P#", None, "impl<T> Show for P#"), (8, "method", "f", "P#", "fn f( &self, ) -> i32")]),
    ("Z#.cs", "[Serializable]\npublic class R# {\n  public int S { get; set; } = 3;\n  int a, b;\n  public R#(int x) : base(x) { }\n  public int Two(\n    int n) => n;\n}\n", [(2, "class", "R#", None, "public class R#"), (3, "property", "S", "R#", "public int S"), (4, "property", "a", "R#", "int a, b;"), (4, "property", "b", "R#", "int a, b;"), (5, "method", "R#", "R#", "public R#(int x) : base(x)"), (6, "method", "Two", "R#", "public int Two( int n) => n;")]),
]


def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_DECLARED = ", ".join(f"({_sql_text(name)}, {n}, {_sql_text(kind)}, {_sql_text(what)}, {_sql_text(holder)}, {_sql_text(code)})" for name, _, rows in _LANGUAGES for n, kind, what, holder, code in rows)


@query(
    "codemap_languages",
    f"""WITH d(path, line_no, kind, name, container, signature) AS (VALUES {_DECLARED}), k AS (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier)
    SELECT replace(path, '#', k) AS path, line_no, kind, CASE WHEN kind = 'preview' THEN name ELSE replace(name, '#', k) END AS name, replace(container, '#', k) AS container, CASE WHEN kind IN ('preview', 'macro') THEN '#' || replace(substr(signature, 2), '#', k) ELSE replace(signature, '#', k) END AS signature FROM d, k""",
)
def codemap_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of files in fourteen languages and several layouts, one of each for every supplier."""
    sources = spark.createDataFrame([(name, text) for name, text, _ in _LANGUAGES], "name string, text string")
    k = F.col("s_suppkey").cast("string")
    # a number sign that leads a line of its own is part of the language
    text = F.regexp_replace("text", "(?<!^|\n)#(?!\\[)", k)
    # the table is one small file, of which much code is made: its rows are spread before
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    code = suppliers.crossJoin(F.broadcast(sources)).select(F.replace("name", F.lit("#"), k).alias("path"), text.alias("content"))  # a row for each file of the list on one side
    return structure.symbols(code).select("path", "line_no", "kind", "name", "container", "signature")


# Intervals and selection

_RANGES = "r AS (SELECT l_orderkey AS key, CAST(l_linenumber * 20 AS BIGINT) AS a, CAST(l_linenumber * 20 + l_quantity AS BIGINT) AS b FROM lineitem)"


@query("interval_union", f"WITH {_RANGES}, o AS (SELECT *, max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r), i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT key, min(a) AS start, max(b) AS \"end\" FROM i GROUP BY key, n")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.normalise(ranges(spark, sf_dir), "key")


@query(
    "interval_difference",
    """WITH w AS (SELECT l_orderkey AS key, CAST(min(l_linenumber) * 20 AS BIGINT) AS a, CAST(max(l_linenumber) * 20 + 30 AS BIGINT) AS b FROM lineitem GROUP BY 1),
    c AS (SELECT l_orderkey AS key, CAST(l_linenumber * 20 + 5 AS BIGINT) AS a, CAST(l_linenumber * 20 + 5 + l_quantity % 12 AS BIGINT) AS b FROM lineitem),
    p AS (SELECT key, unnest(generate_series(a, b)) AS x FROM w), q AS (SELECT DISTINCT key, unnest(generate_series(a, b)) AS x FROM c), d AS (SELECT p.key, p.x FROM p ANTI JOIN q ON p.key = q.key AND p.x = q.x),
    i AS (SELECT key, x, x - row_number() OVER (PARTITION BY key ORDER BY x) AS g FROM d) SELECT key, min(x) AS start, max(x) AS "end" FROM i GROUP BY key, g""",
)
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // PART_ROWS))
    whole = items.repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("key")).agg((F.min("l_linenumber") * 20).cast("long").alias("start"), (F.max("l_linenumber") * 20 + 30).cast("long").alias("end"))
    cut = items.select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 20 + 5).cast("long").alias("start"), (F.col("l_linenumber") * 20 + 5 + F.col("l_quantity").cast("long") % 12).alias("end"))
    return intervals.subtract(whole, cut, "key", partitions=parts)


_SELECTED = "e AS (SELECT coalesce(lang, 'und') AS session_id, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'und'), d.doc_id || '.txt') AS path, CASE WHEN toxic = 1 THEN 'codemap' WHEN quality = 1 THEN 'full' END AS mode, coalesce(text, '') AS content FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 1)"


@query("selection_totals", f"WITH {_SELECTED}, t AS (SELECT *, CASE WHEN mode = 'full' THEN {_TOKENS.format('content')} ELSE 0 END AS n FROM e) SELECT session_id, count(*) AS files, count(*) FILTER (mode = 'full') AS full_files, count(*) FILTER (mode = 'codemap') AS codemap_files, CAST(sum(n) AS BIGINT) AS full_tokens, CAST(sum(n) AS BIGINT) AS total_tokens FROM t GROUP BY 1")
def selection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.totals(selection.measured(selected(spark, sf_dir), files(spark, sf_dir))).select("session_id", "files", "full_files", "codemap_files", "full_tokens", "total_tokens")


@query("selection_upsert", f"WITH {_SELECTED}, u AS (SELECT session_id, path, 'codemap' AS mode FROM e WHERE path LIKE '%5.txt'), m AS (SELECT session_id, path, mode FROM u UNION ALL SELECT session_id, path, mode FROM e WHERE path NOT LIKE '%5.txt') SELECT session_id, path, mode FROM m")
def selection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    before = selection.measured(selected(spark, sf_dir), rows)
    update = selected(spark, sf_dir).where(F.col("path").endswith("5.txt")).withColumn("mode", F.lit("codemap"))
    return selection.add(before, update, rows).select("session_id", "path", "mode")


@query("selection_slices", f"WITH {_SELECTED} SELECT session_id, path, 'slices' AS mode, 1 AS start, CAST(least(4, len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END) AS INTEGER) AS \"end\" FROM e WHERE mode = 'full' AND content <> ''")
def selection_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and reversed ranges added one after the other meet in one range."""
    rows = files(spark, sf_dir)
    chosen = selected(spark, sf_dir).where("mode = 'full'").withColumn("mode", F.lit("slices"))
    part = lambda a, b: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(None).cast("string").alias("description")))
    first = selection.measured(chosen.withColumn("slices", part(2, 1)), rows)
    both = selection.add(first, chosen.withColumn("slices", part(3, 4)), rows)
    return both.select("session_id", "path", "mode", F.inline("slices")).drop("description")


@query("selection_remove", f"WITH {_SELECTED} SELECT session_id, path, mode FROM e WHERE NOT (path LIKE '%2.txt')")
def selection_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    before = selection.measured(selected(spark, sf_dir), rows)
    return selection.remove(before, selected(spark, sf_dir).where(F.col("path").endswith("2.txt")), rows).select("session_id", "path", "mode")


@query("selection_invalidate", f"WITH {_SELECTED} SELECT session_id, path, CASE WHEN mode = 'full' AND path NOT LIKE '%3.txt' AND content <> '' THEN 'slices' WHEN mode = 'full' THEN 'full' ELSE mode END AS mode, mode = 'full' AND path LIKE '%3.txt' AS slices_invalidated FROM e")
def selection_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of files that have changed since turn to whole files."""
    rows = files(spark, sf_dir)
    part = F.array(F.struct(F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit(None).cast("string").alias("description")))
    chosen = selected(spark, sf_dir)
    chosen = chosen.withColumn("slices", F.when(F.col("mode") == "full", part).otherwise(F.col("slices"))).withColumn("mode", F.when(F.col("mode") == "full", F.lit("slices")).otherwise(F.col("mode")))
    before = selection.measured(chosen, rows)
    now = rows.withColumn("content", F.when(F.col("path").endswith("3.txt"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return selection.invalidate(before, now).select("session_id", "path", "mode", "slices_invalidated")


_CUT = "c AS (SELECT session_id, path, content, CASE WHEN content LIKE '%' || chr(10) THEN list_slice(string_split(content, chr(10)), 1, -2) ELSE string_split(content, chr(10)) END AS ls FROM e WHERE mode = 'full' AND content <> '')"


def _sliced(spark: SparkSession, sf_dir: str, *parts: tuple[int, int]) -> DataFrame:
    """The selection's full entries as slices."""
    slices = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(None).cast("string").alias("description")) for a, b in parts])
    return selected(spark, sf_dir).where("mode = 'full'").withColumn("mode", F.lit("slices")).withColumn("slices", slices)


@query(
    "selection_remove_slices",
    f"""WITH {_SELECTED}, {_CUT}, s AS (SELECT session_id, path, content, ls, unnest([1, 4]) AS n FROM c), k AS (SELECT session_id, path, n, ls[n] || CASE WHEN n < len(ls) OR content LIKE '%' || chr(10) THEN chr(10) ELSE '' END AS t FROM s WHERE n <= len(ls)),
    o AS (SELECT session_id, path, CAST(n AS INTEGER) AS start, CAST(n AS INTEGER) AS "end", {_TOKENS.format('t')} AS tokens FROM k) SELECT session_id, path, start, "end", CAST(sum(tokens) OVER (PARTITION BY session_id, path) AS BIGINT) AS tokens_slices FROM o""",
)
def selection_remove_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lines 1 to 4, lines 2 and 3 are taken out again; tokens are those of the lines left."""
    rows = files(spark, sf_dir)
    before = selection.measured(_sliced(spark, sf_dir, (1, 4)), rows)
    left = selection.remove(before, _sliced(spark, sf_dir, (2, 3)), rows)
    return left.select("session_id", "path", "tokens_slices", F.inline("slices")).drop("description")


@query("selection_replace", f"WITH {_SELECTED} SELECT session_id, path, mode FROM e WHERE session_id <> 'en' OR path LIKE '%1.txt'")
def selection_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session is set anew; the others stay."""
    rows = files(spark, sf_dir)
    return selection.replace(selection.measured(selected(spark, sf_dir), rows), selected(spark, sf_dir).where("session_id = 'en' AND path LIKE '%1.txt'"), rows).select("session_id", "path", "mode")


@query("selection_modes", f"WITH {_SELECTED} SELECT session_id, path, CASE WHEN path LIKE '%4.txt' THEN 'codemap' WHEN path LIKE '%6.txt' THEN 'full' ELSE mode END AS mode FROM e WHERE path NOT LIKE '%8.txt'")
def selection_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some entries are demoted, some promoted, some forgotten; paths that are not selected stay out."""
    rows = files(spark, sf_dir)
    before = selection.measured(selected(spark, sf_dir), rows)
    named = lambda end: rows.where(F.col("path").endswith(end)).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("session_id"), "path")
    after = selection.set_mode(selection.set_mode(before, named("4.txt"), "codemap"), named("6.txt"), "full")
    return selection.forget(after, named("8.txt")).select("session_id", "path", "mode")


@query(
    "selection_snapshot",
    f"""WITH {_MAPS}, c AS (SELECT * FROM m WHERE k % 3 = 0), d AS (SELECT DISTINCT m.path, m.text FROM c JOIN m ON m.k = c.k // 2 WHERE m.path NOT IN (SELECT path FROM c))
    SELECT 'one' AS session_id, path, 'full' AS mode, false AS auto, NULL AS tokens_codemap FROM c UNION ALL SELECT 'one', path, 'codemap', true, {_TOKENS.format('text')} FROM d""",
)
def selection_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit entries and, as codemaps, the files that define what they refer to."""
    code = _code(spark, sf_dir)
    found = structure.symbols(code)
    maps = structure.codemaps(found)
    entries = code.where(F.regexp_extract("path", "(\\d+)", 1).cast("int") % 3 == 0).select(F.lit("one").alias("session_id"), "path", F.lit("full").alias("mode"), F.array().cast(selection.SLICES).alias("slices"))
    explicit = selection.measured(entries, code)
    shown = selection.with_auto(explicit, selection.closure(explicit, structure.references(found), structure.type_index(found)), code, maps)
    return shown.select("session_id", "path", "mode", "auto", F.when(F.col("auto"), F.col("tokens_codemap")).alias("tokens_codemap"))


@query("selection_content", f"WITH {_SELECTED}, {_CUT} SELECT session_id, path, sha256(array_to_string(list_slice(ls, 1, CASE WHEN len(ls) = 3 THEN 3 ELSE 2 END), chr(10)) || CASE WHEN len(ls) > 3 OR content LIKE '%' || chr(10) THEN chr(10) ELSE '' END || CASE WHEN len(ls) >= 4 THEN ls[4] || CASE WHEN len(ls) > 4 OR content LIKE '%' || chr(10) THEN chr(10) ELSE '' END ELSE '' END) AS text_sha256 FROM c")
def selection_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of lines 1, 2 and 4 of each file; a slice beyond the end is moved to the last line."""
    rows = files(spark, sf_dir)
    return selection.view(selection.measured(_sliced(spark, sf_dir, (1, 2), (4, 4)), rows), "content", rows).select("session_id", "path", F.sha2("text", 256).alias("text_sha256"))


@query(
    "prompt_log",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, CASE event_type WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'clear' ELSE 'append' END AS action, coalesce(props, '') AS text FROM events),
    p AS (SELECT *, sum(CASE WHEN action <> 'append' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_id) AS epoch FROM e), q AS (SELECT * FROM p QUALIFY epoch = max(epoch) OVER (PARTITION BY session_id))
    SELECT session_id, string_agg(CASE WHEN action = 'clear' THEN '' ELSE text END, '' ORDER BY event_id) AS prompt FROM q GROUP BY 1""",
)
def prompt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts after a log in which each user sets, appends to and clears one."""
    action = F.when(F.col("event_type") == "signup", F.lit("set")).when(F.col("event_type") == "purchase", F.lit("clear")).otherwise(F.lit("append"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("at"), action.alias("action"), F.col("props").alias("text"))
    return selection.prompts_after(log).select("session_id", "prompt")


@query("selection_latest", "WITH e AS (SELECT event_type AS session_id, 'u' || user_id AS path, event_id, CASE WHEN value > 20 THEN 'full' END AS mode FROM events) SELECT session_id, path, mode FROM e QUALIFY row_number() OVER (PARTITION BY session_id, path ORDER BY event_id DESC) = 1 AND mode IS NOT NULL")
def selection_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each entry in a log of upserts, where a null mode means that it has left."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("session_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("value") > 20, F.lit("full")).alias("mode"), "event_id")
    return selection.latest(log, "event_id").select("session_id", "path", "mode")


# Packaging


@query("intent_detect", "SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')), 'review mode|code review|review (changes|the changes|the diff|the pr|this pr|pull request|my changes|my pr)|git diff|pull request|pr review|compare (branch|main|master)') OR role = 'review' AS review FROM conversations")
def intent_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", packaging.review_intent(F.col("role"), F.col("text")).alias("review"))


@query("preset_resolve", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'plan' WHEN event_type = 'error' THEN 'review' ELSE 'standard' END AS preset FROM events")
def preset_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", F.lit("plan")).when(F.col("event_type") == "error", F.lit("review")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", packaging.preset(F.lit(None).cast("string"), kind, F.col("props"), ["standard", "plan", "review", "diff-followup", "mvp"]).alias("preset"))


def _bundled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The whole selection, in sessions that a token budget admits."""
    rows = files(spark, sf_dir)
    entries = packaging.in_bundles(selection.measured(selected(spark, sf_dir), rows), BUNDLE_TOKENS)
    contents = packaging.joined_blocks(packaging.file_blocks(entries, rows)).withColumn("section", F.lit("file_contents"))
    prompts = entries.select("session_id").distinct().select("session_id", F.lit("user_instructions").alias("section"), F.lit("Explain.").alias("text"))
    return entries, contents.select("session_id", "section", "text").unionByName(prompts)


_PACKED = f"""{_SELECTED}, w AS (SELECT *, CASE WHEN mode = 'full' THEN {_TOKENS.format('content')} ELSE 0 END AS own, {_TOKENS.format('path')} + 8 AS more FROM e),
    v AS (SELECT *, coalesce(sum(own + more) OVER (ORDER BY session_id, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w), z AS (SELECT session_id || '#' || CAST(before // {BUNDLE_TOKENS} AS BIGINT) AS session_id, path, mode, content, own FROM v),
    b AS (SELECT session_id, string_agg('File: ' || path || chr(10) || '```txt' || chr(10) || rtrim(content, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '```', chr(10) || chr(10) ORDER BY path) AS t FROM z WHERE mode = 'full' GROUP BY 1),
    x AS (SELECT session_id, CASE WHEN t IS NULL THEN '' ELSE '<file_contents>' || chr(10) || t || chr(10) || '</file_contents>' || chr(10) || chr(10) END || '<user_instructions>' || chr(10) || 'Explain.' || chr(10) || '</user_instructions>' AS text FROM (SELECT DISTINCT session_id FROM z) LEFT JOIN b USING (session_id)),
    m AS (SELECT session_id, CAST(sum(own) AS BIGINT) AS files_full FROM z GROUP BY 1)"""


@query("payload_hash", f"WITH {_PACKED} SELECT session_id, sha256(text) AS content_sha256, {_TOKENS.format('text')} AS tokens FROM x")
def payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packaging.payload(_bundled(spark, sf_dir)[1]).select("session_id", "content_sha256", "tokens")


@query("token_breakdown", f"WITH {_PACKED} SELECT session_id, files_full, 3 AS instructions, {_TOKENS.format('text')} AS total FROM x JOIN m USING (session_id)")
def token_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, sections = _bundled(spark, sf_dir)
    return packaging.breakdown(sections, entries, packaging.payload(sections)).select("session_id", "files_full", "instructions", "total")


@query(
    "receipt",
    f"""WITH {_PACKED}, j AS (SELECT session_id, string_agg(format('{{{{"path":"{{}}","mode":"{{}}","tokens":{{}}}}}}', path, mode, own), ',' ORDER BY path) AS files FROM z GROUP BY 1), t AS (SELECT session_id, files, files_full, sha256(text) AS hash, {_TOKENS.format('text')} AS total FROM x JOIN m USING (session_id) JOIN j USING (session_id))
    SELECT session_id, format('{{{{"generated_at":"2024-01-01T00:00:00.000Z","preset":"standard","budget":160000,"files":[{{}}],"token_breakdown":{{{{"prompt":0,"files_full":{{}},"files_slices":0,"codemaps":0,"instructions":3,"file_tree":0,"git_diff":0,"meta_prompts":0,"total":{{}}}}}},"content_hash":"{{}}"}}}}', files, files_full, total, hash) AS receipt FROM t""",
)
def receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, sections = _bundled(spark, sf_dir)
    made = packaging.payload(sections)
    return packaging.receipt(entries, made, packaging.breakdown(sections, entries, made), "standard", 160_000, "2024-01-01T00:00:00.000Z")


@query(
    "file_map",
    f"""WITH {_MAPS}, e AS (SELECT CAST(k % 7 AS VARCHAR) AS session_id, k % 3 = 0 AS whole, path, text FROM m),
    c AS (SELECT session_id, substr(path, 5) || CASE WHEN whole THEN ' *' ELSE ' +' END AS label, path, path = max(path) OVER (PARTITION BY session_id) AS last FROM e),
    p AS (SELECT DISTINCT session_id, 0 AS k, '' AS path, '(+ denotes codemap available)' || chr(10) || '.' AS text FROM e UNION ALL SELECT DISTINCT session_id, 1, '', chr(10) || '└── src' FROM e
      UNION ALL SELECT session_id, 2, path, chr(10) || '    ' || CASE WHEN last THEN '└── ' ELSE '├── ' END || label FROM c UNION ALL SELECT session_id, 3, path, chr(10) || chr(10) || rtrim(text, chr(10)) FROM e WHERE NOT whole),
    w AS (SELECT *, {_TOKENS.format('text')} + 1 AS cost FROM p), v AS (SELECT *, (sum(cost) OVER (ORDER BY session_id, k, path) - cost) // {MAP_TOKENS} AS n FROM w), z AS (SELECT *, n - min(n) OVER (PARTITION BY session_id) AS part FROM v)
    SELECT session_id, 'file_map' AS section, CAST(part AS BIGINT) AS part, string_agg(text, '' ORDER BY k, path) AS text FROM z GROUP BY session_id, part""",
)
def file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of seven sessions' entries and the structures of those that are codemaps, in parts of about MAP_TOKENS."""
    code = _code(spark, sf_dir)
    k = F.regexp_extract("path", "(\\d+)", 1).cast("int")
    entries = code.select((k % 7).cast("string").alias("session_id"), "path", F.when(k % 3 == 0, F.lit("full")).otherwise(F.lit("codemap")).alias("mode"))
    return packaging.file_map_parts(entries, structure.codemaps(structure.symbols(code)), trees=tree.of_sessions(entries), budget=MAP_TOKENS)


# Edits


@query("edit_occurrences", f"WITH {_FILES} SELECT path, CAST((length(content) - length(replace(content, ' the ', ''))) / 5 AS INTEGER) AS n FROM f")
def edit_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", T.occurrences("content", " the ").alias("n"))


_RULED = r"regexp_replace(regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '^(public|private|internal|protected|static|final|override|export|async) ', ''), '[-=_*~]{4,}', '-', 'g')"
_ENDED = r"regexp_replace({0}, '\s*(->|=>|:=|=|:)$', '')"
#: A line as comparisons see it, and the head of it that edit_normalize shows.
_NORMAL, _NORMAL_HEAD = _ENDED.format(_RULED), _ENDED.format(f"substr({_RULED}, 1, {LINE_HEAD})")


@query("edit_normalize", f"WITH {_FILES}, {_LINES} SELECT path, CAST(line_no AS INTEGER) AS line_no, {_NORMAL_HEAD} AS normal FROM l")
def edit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.line_table(files(spark, sf_dir)).select("path", "line_no", T.normalised_head("line", LINE_HEAD).alias("normal"))


@query("edit_overlap", f"WITH {_FILES}, {_NUMBERED}, o AS (SELECT path, i, '<HEADER-ABCDEFGHIJ>' || content AS c FROM n) SELECT path, CASE WHEN i % 2 = 0 THEN 'failed' ELSE 'applied' END AS status, CASE WHEN i % 2 = 0 THEN 'overlapping_edits' END AS code, CASE WHEN i % 2 = 0 THEN [1, 1] END AS lines, CASE WHEN i % 2 = 1 THEN sha256('1D2' || substr(c, 20)) END AS post_sha256 FROM o")
def edit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of each file's first line, which overlap in every other file."""
    rows = files(spark, sf_dir).withColumn("i", _number()).withColumn("content", F.concat(F.lit("<HEADER-ABCDEFGHIJ>"), "content"))
    second = F.when(F.col("i") % 2 == 0, F.lit("CDEFGHIJ>")).otherwise(F.lit("EFGHIJ>"))
    wanted = lambda k, what, put: rows.select("path", F.lit(k).alias("edit_index"), what.alias("search"), F.lit(put).alias("replace"), F.lit(False).alias("all"))
    both = wanted(0, F.lit("<HEADER-ABC"), "1").unionByName(wanted(1, second, "2"))
    return edits.planned(rows, both).select("path", "status", "error.code", "error.lines", "post_sha256")


@query(
    "edit_tiers",
    f"""WITH {_FILES}, {_NUMBERED}, t AS (SELECT path, i, i % 4 = 3 AS crlf, CASE WHEN i % 2 = 1 THEN 'tab' || chr(9) || '"q"' || chr(10) ELSE 'if ready:' || chr(10) || '        Public   Value = zebra(1)' || chr(10) || '        other' || chr(10) END AS a, CASE WHEN i % 2 = 1 THEN 'done' || chr(9) || chr(10) ELSE 'if ready:' || chr(10) || '        value = lion(2)' || chr(10) || '        more = 3' || chr(10) || '        other' || chr(10) END AS b, content FROM n),
    u AS (SELECT path, i, CASE WHEN crlf THEN replace(a || '.' || chr(10), chr(10), chr(13) || chr(10)) ELSE a || '.' || chr(10) END AS pre, CASE WHEN crlf THEN replace(b || '.' || chr(10), chr(10), chr(13) || chr(10)) ELSE b || '.' || chr(10) END AS post FROM t)
    SELECT path, 'applied' AS status, [CASE WHEN i % 2 = 1 THEN 'escape' ELSE 'fuzzy' END] AS matched_by, sha256(pre) AS pre_sha256, sha256(post) AS post_sha256,
      CASE WHEN i % 2 = 1 THEN '1: done' || chr(9) || chr(10) || '2: .' ELSE '1: if ready:' || chr(10) || '2:         value = lion(2)' || chr(10) || '3:         more = 3' || chr(10) || '4:         other' || chr(10) || '5: .' END AS context FROM u""",
)
def edit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts found with their escapes decoded, or by a fuzzy line whose replacement is moved to its indentation; some of
    the files end their lines with CRLF."""
    i = F.col("i")
    odd = F.lit('tab\t"q"\n.\n')
    even = F.lit("if ready:\n        Public   Value = zebra(1)\n        other\n.\n")
    text = F.when(i % 2 == 1, odd).otherwise(even)
    rows = files(spark, sf_dir).withColumn("i", _number()).withColumn("content", F.when(i % 4 == 3, F.regexp_replace(text, "\n", "\r\n")).otherwise(text))
    find = F.when(i % 2 == 1, F.lit(r'tab\t\"q\"')).otherwise(F.lit("  value = zebra(1)\n"))
    put = F.when(i % 2 == 1, F.lit(r"done\t")).otherwise(F.lit("  value = lion(2)\n  more = 3\n"))
    wanted = rows.select("path", F.lit(0).alias("edit_index"), find.alias("search"), put.alias("replace"), F.lit(False).alias("all"))
    return edits.planned(rows, wanted).select("path", "status", "matched_by", "pre_sha256", "post_sha256", F.get("post_context", 0)["text"].alias("context"))


@query(
    "edit_rewrite",
    f"""WITH {_FILES}, {_NUMBERED}, t AS (SELECT path, i, i % 5 = 0 AS gone, CASE WHEN i % 3 = 0 THEN replace(content, chr(10), chr(13) || chr(10)) ELSE content END AS content FROM n),
    u AS (SELECT *, (length(content) - length(replace(content, chr(13) || chr(10), ''))) / 2 AS crlf, length(content) - length(replace(content, chr(10), '')) AS lf FROM t),
    r AS (SELECT path, gone, CASE WHEN gone THEN 'one' || chr(10) || 'two' ELSE replace('one' || chr(10) || 'two' || CASE WHEN content LIKE '%' || chr(10) THEN chr(10) ELSE '' END, chr(10), CASE WHEN crlf > lf - crlf THEN chr(13) || chr(10) ELSE chr(10) END) END AS after FROM u)
    SELECT path, 'applied' AS status, gone AS file_created, sha256(after) AS post_sha256, '1: one' || chr(10) || '2: two' AS context FROM r""",
)
def edit_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole new texts for all files, a fifth of which do not exist and are created."""
    rows = files(spark, sf_dir).withColumn("i", _number())
    wanted = rows.select("path", F.lit("one\ntwo").alias("rewrite"))
    held = rows.where("i % 5 <> 0").withColumn("content", F.when(F.col("i") % 3 == 0, F.regexp_replace("content", "\n", "\r\n")).otherwise(F.col("content")))
    return edits.rewritten(held, wanted, create=True).select("path", "status", "file_created", "post_sha256", F.get("post_context", 0)["text"].alias("context"))


@query("edit_apply", f"WITH {_FILES} SELECT path, 'applied' AS status, sha256(replace(content, ' the ', ' THE ')) AS post_sha256 FROM f WHERE contains(content, ' the ')")
def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).where(F.contains("content", F.lit(" the ")))
    wanted = rows.select("path", F.lit(0).alias("edit_index"), F.lit(" the ").alias("search"), F.lit(" THE ").alias("replace"), F.lit(True).alias("all"))
    return edits.planned(rows, wanted).select("path", "status", "post_sha256")


@query("edit_errors", f"WITH {_FILES}, n AS (SELECT path, (length(content) - length(replace(content, 'tion', ''))) // 4 AS n FROM f WHERE contains(content, 'tion')) SELECT path, CASE WHEN n > 1 THEN 'multiple_matches' END AS code FROM n")
def edit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).where(F.contains("content", F.lit("tion")))
    wanted = rows.select("path", F.lit(0).alias("edit_index"), F.lit("tion").alias("search"), F.lit("").alias("replace"), F.lit(False).alias("all"))
    return edits.planned(rows, wanted).select("path", "error.code")


_LIMIT = "CASE WHEN length({0}) <= 4 THEN 0.25 WHEN length({0}) <= 7 THEN 0.35 WHEN length({0}) <= 12 THEN 0.5 WHEN length({0}) <= 20 THEN 0.65 WHEN length({0}) <= 40 THEN 0.7 ELSE 0.8 END"


@query(
    "edit_fuzzy",
    f"""WITH {_FILES}, {_LINES}, n AS (SELECT path, line_no, line, length(line) AS size, {_NORMAL} AS s FROM l),
    w AS (SELECT path, {_NORMAL} AS y FROM (SELECT path, arg_min(line, line_no) || ' zq' AS line FROM n WHERE s <> '' GROUP BY 1)),
    g AS (SELECT path, line_no, size, s, y, list_transform(generate_series(1, length(s) - 1), lambda i: substr(s, i, 2)) AS a, list_transform(generate_series(1, length(y) - 1), lambda i: substr(y, i, 2)) AS b FROM n JOIN w USING (path)),
    c AS (SELECT path, line_no, size, s, y, CASE WHEN s = y THEN 1.0 WHEN length(s) < 2 OR length(y) < 2 THEN 0.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda u: u = t)), len(list_filter(b, lambda u: u = t))))), 0) / (len(a) + len(b)) END AS dice FROM g),
    e AS (SELECT *, bool_or(s = y) OVER (PARTITION BY path) AS exact, sum(size + 1) OVER (PARTITION BY path ORDER BY line_no) - size - 1 AS base, max(line_no) OVER (PARTITION BY path) AS last FROM c),
    q AS (SELECT path, list({{'n': line_no, 'd': dice, 'a': base, 'b': base + size + CASE WHEN line_no < last OR f.content LIKE '%' || chr(10) THEN 1 ELSE 0 END}} ORDER BY line_no) FILTER (CASE WHEN exact THEN s = y ELSE dice >= {_LIMIT.format('y')} END) AS hits, arg_max(line_no, dice * 1000000 - line_no / 1000000.0) AS best FROM e JOIN f USING (path) GROUP BY path)
    SELECT path, CASE WHEN len(hits) = 1 THEN 'fuzzy' END AS matched_by, CASE WHEN len(hits) = 1 THEN round(hits[1].d, 6) END AS dice, CASE WHEN len(hits) = 1 THEN CAST(hits[1].a AS INTEGER) END AS start, CASE WHEN len(hits) = 1 THEN CAST(hits[1].b AS INTEGER) END AS "end",
      CASE WHEN len(hits) > 1 THEN 'ambiguous_match' WHEN coalesce(len(hits), 0) = 0 THEN 'no_match' END AS code, CASE WHEN len(hits) > 1 THEN list_transform(hits, lambda h: CAST(h.n AS INTEGER)) WHEN coalesce(len(hits), 0) = 0 THEN [CAST(best AS INTEGER)] END AS lines FROM q""",
)
def edit_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's first line with words, changed a little, looked for among all lines of the file by the three tiers."""
    rows = files(spark, sf_dir)
    with_words = lambda lines: F.get(F.filter(lines, lambda x: T.normalised_line(x) != ""), 0)
    # all lines are compared only where none of the first few has words
    first = F.coalesce(*(with_words(F.slice(F.split("content", "\r?\n", n + 1), 1, n)) for n in (1, 8)), with_words(T.lines("content")))
    wanted = rows.select("path", F.lit(0).alias("edit_index"), F.concat(first, F.lit(" zq")).alias("search"), F.lit("found").alias("replace"), F.lit(False).alias("all")).where("search IS NOT NULL")
    return edits.resolved(rows, wanted).select("path", "matched_by", F.round("dice", 6).alias("dice"), F.get("spans", 0)["start"].alias("start"), F.get("spans", 0)["end"].alias("end"), "error.code", "error.lines")


@query("diff_linewise", f"WITH {_FILES}, {_LINES}, b AS (SELECT path, list(line ORDER BY line_no) AS ls FROM l GROUP BY 1), c AS (SELECT path, ls, string_split(replace(array_to_string(ls, chr(10)), 'that', 'this'), chr(10)) AS rs FROM b) SELECT path, list_concat(list_transform(list_filter(ls, lambda x: NOT list_contains(rs, x)), lambda x: '-' || x), list_transform(list_filter(rs, lambda x: NOT list_contains(ls, x)), lambda x: '+' || x)) AS diff FROM c")
def diff_linewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("content <> ''").select("path", edits.line_diff("content", F.replace("content", F.lit("that"), F.lit("this"))).alias("diff"))


# Version control: records made of events


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("status_parse", "SELECT 'f' || event_id || ' x.txt' AS path, CASE event_type WHEN 'click' THEN 'staged' WHEN 'purchase' THEN 'unstaged' WHEN 'error' THEN 'deleted' WHEN 'view' THEN 'untracked' END AS state FROM events WHERE event_type <> 'signup' UNION ALL SELECT 'f' || event_id || ' x.txt', 'staged' FROM events WHERE event_type = 'purchase'")
def status_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcs.status_entries(_status_lines(spark, sf_dir)).select("path", "state")


def _status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(" x.txt"))
    xy = F.when(F.col("event_type") == "click", F.lit("M.")).when(F.col("event_type") == "purchase", F.lit("MM")).when(F.col("event_type") == "error", F.lit(".D"))
    ordinary = F.concat(F.lit("1 "), xy, F.lit(" N... 100644 100644 100644 0000 0000 "), name)
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("? "), name)).when(F.col("event_type") == "signup", F.lit("# branch.head main")).otherwise(ordinary)
    return _events(spark, sf_dir).select(F.col("event_id").alias("line_no"), line.alias("line"))


@query("status_totals", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), k AS (SELECT coalesce(sum(n) FILTER (event_type IN ('click', 'purchase')), 0) AS staged, coalesce(sum(n) FILTER (event_type = 'purchase'), 0) AS unstaged, coalesce(sum(n) FILTER (event_type = 'view'), 0) AS untracked, coalesce(sum(n) FILTER (event_type = 'error'), 0) AS deleted FROM c) SELECT 'staged' AS state, CAST(staged AS BIGINT) AS count FROM k UNION ALL SELECT 'unstaged', CAST(unstaged AS BIGINT) FROM k UNION ALL SELECT 'untracked', CAST(untracked AS BIGINT) FROM k UNION ALL SELECT 'deleted', CAST(deleted AS BIGINT) FROM k UNION ALL SELECT 'renamed', 0")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcs.status_totals(vcs.status_entries(_status_lines(spark, sf_dir)))


@query("diff_stats_join", "SELECT 'f' || event_id AS path, substr(upper(event_type), 1, 1) AS status, CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 0 ELSE user_id END AS insertions, CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 0 ELSE event_id % 11 END AS deletions, event_id % 3 <> 0 AND event_id % 7 = 0 AS \"binary\" FROM events")
def diff_stats_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    binary = F.col("event_id") % 7 == 0
    number = lambda c: F.when(binary, F.lit("-")).otherwise(c.cast("string"))
    numstat = rows.where("event_id % 3 <> 0").select(F.concat_ws("\t", number(F.col("user_id")), number(F.col("event_id") % 11), name).alias("line"))
    names = rows.select(F.concat_ws("\t", F.substring(F.upper("event_type"), 1, 1), name).alias("line"))
    return vcs.diff_files(numstat, names).drop("old_path")


@query("diff_totals", "SELECT count(*) AS files, CAST(sum(CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 0 ELSE user_id END) AS BIGINT) AS insertions, CAST(sum(CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 0 ELSE event_id % 11 END) AS BIGINT) AS deletions FROM events")
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcs.diff_totals(diff_stats_join(spark, sf_dir))


@query("log_parse", "SELECT sha256(CAST(event_id AS VARCHAR)) AS sha, left(sha256(CAST(event_id AS VARCHAR)), 7) AS short_sha, 'u' || user_id AS author, strftime(ts, '%Y-%m-%d') AS date_iso, props AS subject FROM events")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.col("event_id").cast("string"), 256)
    line = F.concat_ws(vcs.UNIT, sha, F.substring(sha, 1, 7), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.date_format("ts", "yyyy-MM-dd"), "props")
    return vcs.log_entries(_events(spark, sf_dir).select(line.alias("line")))


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    lines = F.array(F.concat(F.lit("diff --git a/f"), k, F.lit(" b/f"), k), F.lit("--- a/f"), F.concat(F.lit("@@ -"), k, F.lit(",2 +"), (F.col("event_id") + 1).cast("string"), F.lit(",2 @@")), F.concat(F.lit("-"), "event_type"), F.concat(F.lit("+"), "props"), F.lit("@@ -90 +91 @@ more"), F.lit(" same"))
    return _events(spark, sf_dir).select(F.floor(F.col("event_id") / 100).alias("patch_id"), F.col("event_id"), F.posexplode(lines).alias("n", "line")).select("patch_id", (F.col("event_id") * 10 + F.col("n")).alias("line_no"), "line")


@query("patch_hunks", "SELECT 'f' || event_id AS path, 1 AS hunk_no, CAST(event_id AS INTEGER) AS old_start, CAST(event_id + 1 AS INTEGER) AS new_start, '@@ -' || event_id || ',2 +' || (event_id + 1) || ',2 @@' || chr(10) || '-' || event_type || chr(10) || '+' || props AS patch, 0 AS omitted_lines FROM events UNION ALL SELECT 'f' || event_id, 2, 90, 91, '@@ -90 +91 @@ more', 1 FROM events")
def patch_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcs.patch_hunks(_patches(spark, sf_dir), max_lines=4, group="patch_id").select("path", "hunk_no", "old_start", "new_start", "patch", "omitted_lines")


@query("head_truncate", f"WITH {_FILES}, c AS (SELECT path, string_split(content, chr(10)) AS ls FROM f) SELECT path, sha256(array_to_string(list_slice(ls, 1, 3), chr(10)) || CASE WHEN len(ls) > 3 THEN chr(10) || '... (' || (len(ls) - 3) || ' more lines omitted)' ELSE '' END) AS head_sha256 FROM c")
def head_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.sha2(vcs.head_lines(F.col("content"), 3), 256).alias("head_sha256"))


@query("branch_facts", "SELECT 'main' AS branch, 'origin/main' AS upstream, CAST(count(*) FILTER (event_type = 'click') % 100 AS INTEGER) AS ahead, CAST(count(*) % 50 AS INTEGER) AS behind FROM events")
def branch_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header lines of a status, beside its entries."""
    counts = table(spark, sf_dir, "events").agg((F.count_if(F.col("event_type") == "click") % 100).alias("a"), (F.count(F.lit(1)) % 50).alias("b"))
    head = counts.select(F.explode(F.array(F.lit("# branch.head main"), F.lit("# branch.upstream origin/main"), F.concat(F.lit("# branch.ab +"), F.col("a").cast("string"), F.lit(" -"), F.col("b").cast("string")))).alias("line"))
    return vcs.branch_facts(head.unionByName(_status_lines(spark, sf_dir).where("line NOT LIKE '#%'").select("line")))


@query("blame_lines", "SELECT CAST(event_id AS INTEGER) AS line, left(sha256(CAST(user_id AS VARCHAR)), 8) AS sha_short, 'u' || user_id AS author, props AS content FROM events")
def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 40)
    first = F.row_number().over(Window.partitionBy(F.floor(F.col("event_id") / 100), "user_id").orderBy("event_id")) == 1
    head = F.concat(sha, F.lit(" 1 "), F.col("event_id").cast("string"), F.lit(" 1"))
    facts = F.when(F.col("first"), F.array(F.concat(F.lit("author u"), F.col("user_id").cast("string")), F.lit("author-time 1700000000"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(head), facts, F.array(F.concat(F.lit("\t"), "props")))
    rows = _events(spark, sf_dir).withColumn("first", first).select(F.floor(F.col("event_id") / 100).alias("file"), "event_id", F.posexplode(lines).alias("n", "line")).select("file", (F.col("event_id") * 10 + F.col("n")).alias("line_no"), "line")
    return vcs.blame_lines(rows, group="file").select("line", "sha_short", "author", "content")
