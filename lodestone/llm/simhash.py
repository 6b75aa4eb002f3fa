"""SimHash near-duplicates: 64-bit fingerprints, linked when 3 or fewer bits differ, and their components.

Linking embeds a fingerprint as the bit counts of its 32 two-bit segments. The Manhattan distance of two
embeddings never exceeds the number of differing bits, so it serves as a lower bound. The counts are kept
in unary (0: 00, 1: 01, 2: 11) in one long, in which that distance is the bit count of an exclusive or.

The range join of embeddings within distance 3 runs over grids. The segments form groups, and a distance of 3
touches 3 groups at most, so in some choice of all groups but 3 the two points have distance 0: a grid over each
choice, with cells of one point along these groups and of unbounded width along the others, brings every pair
within range to a common cell, and no neighbouring cell needs to be met. Pairs of a cell are held against the
lower bound over all segments and then against the fingerprints themselves. Cells with many members are cut again
by grids over the segments that are still unbounded. The number of groups only sets how many members a cell has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import carried, checkpoint_dir

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
#: Numbers of groups to choose from, and the members that a cell of unlike fingerprints should have at most.
GROUPS, CELL_FILL = (6, 7, 8, 9), 16
#: Members of a cell that are held against each other directly; larger cells are first thinned, see links().
CELL_BLOCK = 256
#: Rows of keys that may be broadcast.
MOST_BROADCAST = 1_000_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text: a bit is set where over half the shingle hashes have it; 0 without words."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - SHINGLE_WORDS + 1].tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", column: str = "simhash") -> DataFrame:
    """docs without the text column and with the fingerprint as a (signed) long; a null text has fingerprint 0."""
    rows, fields = carried(docs, docs.columns, [text, column], [F.col(f"`{text}`")])
    schema = T.StructType([*fields, T.StructField(column, T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = np.array([fingerprint(t) for t in part.column(part.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], names=names)

    return rows.mapInArrow(run, schema)


def unary_counts(fp: str) -> Column:
    """The 32 bit counts of a fingerprint's two-bit segments, each in unary."""
    odd = F.lit(0x5555555555555555)
    low, high = F.col(fp).bitwiseAND(odd), F.shiftrightunsigned(F.col(fp), 1).bitwiseAND(odd)
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseOR(low))


def _mask(segments: list[int]) -> int:
    return sum(3 << (2 * s) for s in segments)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def grid_masks(groups: int, distance: int = MAX_BITS, within: int = (1 << 64) - 1) -> list[int]:
    """The bits of each choice of groups - distance groups of those segments that `within` has."""
    parts = np.array_split(np.array([s for s in range(32) if within >> (2 * s) & 1]), groups)
    own = [_mask([int(s) for s in part]) for part in parts]
    return [sum(own[i] for i in chosen) for chosen in combinations(range(groups), groups - distance)]


def groups_for(nodes: int) -> int:
    """The fewest groups with which unlike fingerprints leave CELL_FILL members in a cell; every choice finds the
    same links. A segment's count tells 1.41 bits of it."""
    return next((g for g in GROUPS if nodes / 2 ** (1.41 * 32 * (g - MAX_BITS) / g) <= CELL_FILL), GROUPS[-1])


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def with_members(cells: DataFrame) -> DataFrame:
    """cells that share grid and key with others, with the number of such rows. Counts combine before they are
    shuffled and are joined back, so that a very large cell can be split among tasks."""
    counts = cells.groupBy("grid", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return cells.join(counts, ["grid", "key"])


def _near(extra: Column | None = None) -> Column:
    met = (F.col("l.grid") == F.col("r.grid")) & (F.col("l.key") == F.col("r.key")) & (_differ("l.counts", "r.counts") <= MAX_BITS) & (_differ("l.fp", "r.fp") <= MAX_BITS)
    return met if extra is None else met & extra


def _pairs(l: DataFrame, r: DataFrame, met: Column) -> DataFrame:
    return l.alias("l").join(r.alias("r"), met).select(F.greatest("l.fp", "r.fp").alias("a"), F.least("l.fp", "r.fp").alias("b"))


def links(nodes: DataFrame, fp: str = "fp", block: int = CELL_BLOCK, groups: int | None = None) -> DataFrame:
    """Links (a, b) of distinct fingerprints, enough of them to give the same components as all links.

    Cells of up to `block` members give all their links. Members of larger cells that differ in one bit are first
    joined in stars around the smallest of them, with 64 rows for a member; then only links between members that
    the stars have left apart matter. A large cell whose members are all joined is done. The others are cut by grids
    over their other segments, and in what is still large, the members outside the star component with the most
    members are held against all others, in blocks. So no task holds a whole large cell, and no link that matters
    is lost.
    """
    groups = groups or groups_for(nodes.count())
    masks = grid_masks(groups)
    cells = nodes.select(F.col(fp).alias("fp"), unary_counts(fp).alias("counts")).select(
        "fp", "counts", F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("cell")
    ).select("fp", "counts", "cell.grid", "cell.key")
    sized = with_members(cells).checkpoint()
    small = sized.where(F.col("members") <= block)
    direct = _pairs(small, small, _near(F.col("l.fp") < F.col("r.fp")))
    large = sized.where(F.col("members") > block)
    if large.isEmpty():
        return direct.distinct()
    crowd = large.select("fp").distinct()
    cleared = crowd.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed((1 << 64) - 1 - (1 << i)))).alias("rest")) for i in range(64)])).alias("c"))
    hubs = cleared.groupBy("c").agg(F.min("fp").alias("b"), F.max("fp").alias("a")).where("a <> b").select("a", "b")  # a cleared bit leaves two values at most
    hubs = hubs.checkpoint()
    parts = components(nodes.sparkSession, hubs).select(F.col("node").alias("fp"), "root")
    apart = _of_several_roots(large.drop("members").join(parts, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    finer = F.array(*[F.array(*[F.struct(F.lit(i * 1000 + j).alias("grid"), F.lit(_signed(m | n)).alias("mask")) for j, n in enumerate(grid_masks(6, within=((1 << 64) - 1) ^ m))]) for i, m in enumerate(masks)])
    cut = apart.select("fp", "counts", "root", F.explode(F.get(finer, F.col("grid"))).alias("f"))
    cut = cut.select("fp", "counts", "root", F.col("f.grid").alias("grid"), F.col("counts").bitwiseAND(F.col("f.mask")).alias("key"))
    cut = _of_several_roots(with_members(cut)).checkpoint()
    few = cut.where(F.col("members") <= block)
    across = _pairs(few, few, _near((F.col("l.fp") < F.col("r.fp")) & (F.col("l.root") != F.col("r.root"))))
    many = cut.where(F.col("members") > block)
    if not many.isEmpty():
        across = across.unionByName(_across_blocks(many, block))
    return direct.unionByName(hubs).unionByName(across).distinct()


def _of_several_roots(cells: DataFrame) -> DataFrame:
    """The rows of cells that hold more than one root."""
    mixed = cells.groupBy("grid", "key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("grid", "key")
    return cells.join(mixed, ["grid", "key"])


def _across_blocks(cells: DataFrame, block: int) -> DataFrame:
    """Links between roots in large cells. Every member lies in one of a cell's blocks; those that are not of the
    root with the most members in the cell are dealt to all of its blocks and held against their members."""
    held = cells.groupBy("grid", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = held.groupBy("grid", "key").agg(F.max(F.struct("n", "root")).alias("m")).select("grid", "key", F.col("m.root").alias("main"))
    rows = cells.join(main, ["grid", "key"]).withColumn("blocks", F.ceil(F.col("members") / block))
    own = rows.withColumn("at", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    others = rows.where("root <> main").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))))
    return _pairs(others, own, _near((F.col("l.at") == F.col("r.at")) & (F.col("l.root") != F.col("r.root"))))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that can be reached.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest
    neighbour, then its smaller ones. The number of rounds grows with the logarithm of the longest path.
    """
    checkpoint_dir(spark)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = sign(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = small.checkpoint()
        now = sign(edges)
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classed(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = CELL_BLOCK) -> DataFrame:
    """(_key, fp, root, component_id) for each row of docs: root is the component's smallest fingerprint."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    marked = fingerprints(docs.select(F.col(key).alias("_key"), F.col(text).alias("_doc")), "_doc", "fp").checkpoint()
    nodes = marked.groupBy("fp").agg(F.min("_key").alias("first_key")).checkpoint()
    roots = components(spark, links(nodes, "fp", block))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("first_key").alias("component_id"))
    return marked.join(named.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = CELL_BLOCK) -> DataFrame:
    """(key, simhash, component_id): each document's fingerprint and the smallest key that links reach from it.

    Repeated rows stay, each with its component. Texts without words share fingerprint 0 and so one component.
    Null keys never name a component; a component without any other key has a null name. Extra columns are not
    read, and an empty table gives an empty result.
    """
    return classed(docs, text, key, block).select(F.col("_key").alias(key), F.col("fp").alias("simhash"), "component_id")


def hex_digits(column: str) -> Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _bounded(rows: DataFrame) -> DataFrame:
    """rows (which are checkpointed), marked for a broadcast where their number allows it."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document of each component: that with the smallest key. All columns stay.

    Where several rows have that key, the one whose text has the smallest digest stays; which of rows that agree in
    key and text stays, whatever their other columns say, is left open. A document with a null key stays only where its
    component has no other key. Keys alone decide for all keys that occur once, so texts are shuffled only where
    more than MOST_BROADCAST documents go, and then once; keys that occur more than once are worked out apart.
    """
    found = classed(docs, text, key).withColumn("stays", F.col("_key").eqNullSafe(F.col("component_id"))).checkpoint()
    keys = found.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("stays").alias("stays"))
    keys = keys.where("n > 1 OR NOT stays").select("_key", (F.col("n") > 1).alias("twice")).checkpoint()
    met = F.col(f"_d.{key}").eqNullSafe(F.col("_k._key"))
    once = docs.alias("_d").join(_bounded(keys).alias("_k"), met, "left_anti")
    twice = keys.where("twice").checkpoint()
    if twice.isEmpty():
        return once
    again = docs.alias("_d").join(_bounded(twice).alias("_k"), met, "left_semi")
    own = [F.col(f"`{c}`") for c in docs.columns]
    again = fingerprints(again.select(F.struct(*own).alias("_row"), F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_doc")), "_doc", "_fp")
    again = again.withColumn("_digest", F.sha2(F.coalesce(F.col(f"_row.`{text}`"), F.lit("")), 256))
    stay = found.where("stays").join(twice.select(F.col("_key").alias("_k")), F.col("_key").eqNullSafe(F.col("_k")), "left_semi").select(F.col("_key").alias("_k"), F.col("fp").alias("_f"), F.col("root").alias("_root")).distinct()
    again = again.join(stay, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_fp") == F.col("_f")))
    least = again.groupBy("_root").agg(F.min("_digest").alias("_least")).withColumnRenamed("_root", "_r")
    chosen = again.join(least, (F.col("_root") == F.col("_r")) & (F.col("_digest") == F.col("_least"))).dropDuplicates(["_root"]).select("_row.*")
    return once.unionByName(chosen)
