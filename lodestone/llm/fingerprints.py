"""Document fingerprints: threshold-scaled sketches in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the document's. A text
with fewer than FEW hashes below the fraction takes the next of the fixed SCALES, the last of which keeps all; the scale
is written with the hashes. Sketches of parts merge into the sketch of the whole by union. Two sketches are brought to
the coarser of their scales, and the share of the smaller one that is found in the other estimates containment, however
unequal the documents are. It is a function of the two sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: One hash in so many is kept: the first that leaves FEW hashes, or else the last.
SCALES = [4, 2, 1]
FEW = 16
#: Where neighbours by key are met: rows of a range of keys, quantiles that part the keys, and the most ranges.
RANGE_ROWS, QUANTILES, MOST_RANGES = 4000, 256, 16384


def words(text: Column) -> Column:
    """Lower-cased words: runs of characters other than ASCII white space."""
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """A 64-bit hash of each run of SHINGLE_WORDS words; of all words if they are fewer, none without words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE_WORDS + 1, F.lit(1))), lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(SHINGLE_WORDS)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(runs)


def below(hashes: Column, scale: Column | int) -> Column:
    """The hashes below 1/scale of the range, from its lower end."""
    bounds = {x: -(1 << 63) + (1 << 64) // x for x in SCALES if x > 1}
    if isinstance(scale, int):
        return hashes if scale == 1 else F.filter(hashes, lambda h: h < bounds[scale])
    found = F.when(scale == 1, hashes)
    for x, bound in bounds.items():
        found = found.when(scale == x, F.filter(hashes, lambda h: h < bound))
    return found


def _sketch(scale: Column | int, hashes: Column) -> Column:
    return F.struct((F.lit(scale) if isinstance(scale, int) else scale).alias("scale"), hashes.alias("hashes"))


def sketch_of_hashes(hashes: Column, finest: Column | int = 1) -> Column:
    """(scale, hashes): the sorted, distinct hashes below the first of SCALES that leaves FEW of them; of the scale
    `finest`, which the hashes were taken by, where none does."""
    ordered = lambda scale: F.array_sort(F.array_distinct(below(hashes, scale)))
    found = None
    for scale in SCALES[:-1]:
        enough = (F.size(ordered(scale)) >= FEW) & (F.lit(scale) >= finest)
        found = (F if found is None else found).when(enough, _sketch(scale, ordered(scale)))
    return found.otherwise(_sketch(finest, ordered(1)))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches; exactly what their joint hashes would give."""
    scale = F.greatest(a["scale"], b["scale"])
    return sketch_of_hashes(F.array_union(below(a["hashes"], scale), below(b["hashes"], scale)), scale)


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller sketch's hashes that the other has, both at the coarser of the two scales; exact where
    both hold all hashes. 1 if neither has a hash there, 0 if one has none."""
    scale = F.greatest(a["scale"], b["scale"])
    x, y = below(a["hashes"], scale), below(b["hashes"], scale)
    least = F.least(F.size(x), F.size(y))
    return F.when(F.greatest(F.size(x), F.size(y)) == 0, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def sketched(docs: DataFrame, text: str = "text", column: str = "sketch") -> DataFrame:
    """docs with the sketch of each whole text; a null text counts as empty and has no hashes. A column of the new name is
    replaced. Rows stay where they are."""
    names = [c.lower() for c in (*docs.columns, column)]
    new = lambda name: name if name not in names else new(name + "_")
    held, hashes, *low = map(new, ["words", "hashes", *(f"below{s}" for s in SCALES[:-1])])
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() != column.lower()]
    step = docs.select("*", words(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(held)).select(*kept, shingle_hashes(F.col(held)).alias(hashes))
    # each array is a column, so that it is worked out once; the finer ones only where the coarser leave too few
    found, most = None, F.lit(False)
    for scale, name in zip(SCALES, low):
        step = step.withColumn(name, F.when(~most, F.array_sort(F.array_distinct(below(F.col(hashes), scale)))))
        most = most | (F.size(name) >= FEW)
        found = (F if found is None else found).when(F.size(name) >= FEW, _sketch(scale, F.col(name)))
    return step.select(*kept, found.otherwise(_sketch(1, F.array_sort(F.array_distinct(F.col(hashes))))).alias(column))


def as_string(sketch: Column) -> Column:
    """A sketch in text: its scale, a colon, and 16 hex digits for each hash."""
    return F.concat(sketch["scale"].cast("string"), F.lit(":"), F.array_join(F.transform(sketch["hashes"], lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ""))


def _range_of(key: Column, bounds: list[float], steps: int) -> Column:
    """The number of a key's range: its place among the bounds, then one of `steps` equal parts in between."""
    value, edges = key.cast("double"), F.array(*map(F.lit, bounds))
    slot = F.greatest(F.lit(1), F.least(F.size(F.filter(edges, lambda b: b <= value)), F.lit(len(bounds) - 1)))
    low, high = F.get(edges, slot - 1), F.get(edges, slot)
    part = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * steps)
    return F.coalesce((slot - 1) * steps + F.greatest(F.lit(0), F.least(F.coalesce(part, F.lit(0)), F.lit(steps - 1))), F.lit(MOST_RANGES)).cast("int")


def in_key_ranges(docs: DataFrame, key: str) -> DataFrame:
    """docs with _range and _ghost: every row in the range of its key, and the first row of a range once more as
    the last (a ghost) of the range before. The first row of all is the ghost of the last range.

    Ranges follow from quantiles of the keys, which is all that the driver sees; there are MOST_RANGES at most,
    so the table of their first keys can be broadcast: above MOST_RANGES * RANGE_ROWS rows (65 million) ranges hold more
    rows, in proportion, and window sorts spill; the result stays the same. Null keys form the last range.
    """
    rows = docs.count()
    steps = max(1, min(rows // (RANGE_ROWS * QUANTILES), MOST_RANGES // QUANTILES))
    cuts = max(1, min(QUANTILES, rows // RANGE_ROWS))
    found = docs.select(F.percentile_approx(F.col(key).cast("double"), [k / cuts for k in range(cuts + 1)], 10_000).alias("b")).first()["b"]
    bounds = sorted(set(found or [0.0]))
    ranged = docs.withColumn("_range", _range_of(F.col(key), bounds if len(bounds) > 1 else [bounds[0], bounds[0] + 1], steps))
    order = F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("key"))
    firsts = ranged.groupBy("_range").agg(F.min(order).alias("first"))
    one = Window.partitionBy(F.lit(0)).orderBy("_range")  # a row for each range
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("before", F.coalesce(F.lag("_range").over(one), F.last("_range").over(whole))).select(F.col("_range").alias("_r"), F.col("first.key").alias("_first"), "before")
    placed = ranged.join(F.broadcast(firsts), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_first")), "left")
    own, ghost = (F.struct(F.col(c).alias("r"), F.lit(g).alias("g")) for c, g in (("_range", 0), ("before", 1)))
    placed = placed.withColumn("_place", F.explode(F.filter(F.array(own, ghost), lambda p: p["r"].isNotNull())))
    return placed.withColumn("_range", F.col("_place.r")).withColumn("_ghost", F.col("_place.g")).drop("_r", "_first", "before", "_place")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row its sketch, that of its text edited with the next row's, and the containment of both pairs.

    The next row is that with the next larger key; the last is followed by the first, and a single row by itself.
    The edited text keeps the first half of the code points (the odd one too) and goes on with as many from the
    start of the next text as the other half has, or all. Rows with equal keys follow in the order of their
    texts. Null texts are empty; null keys come last. Other columns are not read.
    """
    rows = in_key_ranges(docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")), "_key")
    dealt = sketched(rows.repartition("_range"), "_text", "_own")
    order = Window.partitionBy("_range").orderBy("_ghost", F.col("_key").asc_nulls_last(), "_text")
    met = dealt.select("*", F.lead("_text").over(order).alias("_next_text"), F.lead("_own").over(order).alias("_next")).where("_ghost = 0")
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next_text"), F.lit(1), half))
    both = sketched(met.select("_key", n.alias("_n"), edited.alias("_edited_text"), "_own", "_next"), "_edited_text", "_edited")
    return both.select(
        F.col("_key").alias(key),
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2("_edited_text", 256).alias("edited_sha256"),
        as_string(F.col("_own")).alias("fingerprint"),
        as_string(F.col("_edited")).alias("edited_fingerprint"),
        containment(F.col("_own"), F.col("_edited")).alias("near_edited"),
        containment(F.col("_own"), F.col("_next")).alias("near_next"),
    )
