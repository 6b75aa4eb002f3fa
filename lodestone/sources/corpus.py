"""Corpora as DataFrames of files: from folders, from tables, and what is derived from a file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators.ordering import ready_to_checkpoint
from lodestone.sources.versions import Versioned, opened

# The sample that is sniffed, the size cap, and the ignore files.
SNIFF_BYTES, SIZE_CAP = 8192, 10_000_000
#: Tasks that walk a folder's tree, and about how many bytes of files a task holds at a time.
WALKERS, READ_BYTES = 256, 64 << 20
#: No file is read whole beyond this, since a row could not hold it.
MOST_WHOLE = 1 << 30
IGNORE_FILES = [".gitignore", ".repo_ignore", ".cursorignore"]


def likely_generated(path: Column | str, text: Column | str) -> Column:
    """Bundles, lock files, and texts whose first 50 lines are over 300 units long on average, blank ones aside."""
    name = P.base_name(path)
    sample = F.slice(F.split(F.substring(T.col(text), 1, SNIFF_BYTES), "\r?\n"), 1, 50)
    full = F.filter(sample, lambda line: F.char_length(F.trim(line)) > 0)
    chars = F.aggregate(full, F.lit(0).cast("long"), lambda n, line: n + F.char_length(line))
    return name.rlike("\\.(min|bundle)\\.[^.]+$") | name.isin(P.LOCK_FILES) | F.coalesce(chars / F.nullif(F.size(full), F.lit(0)) > 300, F.lit(False))


def flagged(files: DataFrame, size_cap: int = SIZE_CAP) -> DataFrame:
    """files (path, size, content text or bytes) with is_binary, oversized, likely_generated and language."""
    raw = F.col("content").cast("binary")
    return files.withColumns(
        {
            "is_binary": F.position(F.lit(b"\x00"), F.substring(raw, 1, SNIFF_BYTES)) > 0,
            "oversized": F.col("size") > size_cap,
            "likely_generated": likely_generated("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))),
            "language": P.language("path"),
        }
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """A corpus from a table of documents: source/lang/doc_id.txt as path, UTF-8 bytes as size."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(path.alias("path"), T.utf8_bytes(F.coalesce("text", F.lit(""))).alias("size"), F.coalesce("text", F.lit("")).alias("content"))


def paths_of_pages(pages: DataFrame) -> DataFrame:
    """A path hierarchy from URLs: scheme, query and fragment go."""
    return pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).where("path <> ''").distinct()


def _entries(system: pa.fs.FileSystem, folder: str) -> tuple[list[str], list[pa.fs.FileInfo]]:
    """Folders that are entered, and files. What cannot be read is left out."""
    found = [e for e in system.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if e.base_name not in P.HARD_IGNORED]
    return [e.path for e in found if e.type == pa.fs.FileType.Directory], [e for e in found if e.type == pa.fs.FileType.File]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, abs_path, size, mtime_ms) of the files below a folder of any file system that Arrow opens.

    Spark's own readers leave out names that begin with a dot or an underscore, which source trees need. The driver
    opens folders only until there is one for each of WALKERS tasks, which walk the rest.
    """
    system, base = opened(root)
    met, ahead = [], [base]
    while ahead and len(ahead) < WALKERS:
        met, ahead = met + ahead, [sub for folder in ahead for sub in _entries(system, folder)[0]]
    start = spark.createDataFrame([(f, False) for f in met] + [(f, True) for f in ahead], "folder string, deep boolean").repartition(max(1, min(len(ahead), WALKERS)))
    shape = pa.schema([("path", pa.string()), ("abs_path", pa.string()), ("size", pa.int64()), ("mtime_ms", pa.float64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, below = opened(root)
        for batch in batches:
            for folder, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left = [folder]
                while left:
                    folders, files = _entries(own, left.pop())
                    left += folders if deep else []
                    rows = [(f.path[len(below) :].lstrip("/"), f.path, int(f.size or 0), (f.mtime_ns or 0) / 1e6) for f in files]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, shape.types, strict=True)], schema=shape)

    return start.mapInArrow(walk, "path string, abs_path string, size long, mtime_ms double")


def listed(spark: SparkSession, root: str, extra_rules: list[str] = (), ios_preset: bool | str = "auto") -> DataFrame:
    """(path, abs_path, size, mtime_ms, stamp) of the files below a folder, less the ignored ones; stamp changes with
    size or time. The folder is walked once and kept by a checkpoint. Ignore files come first; rules of deeper folders
    come later and so win."""
    ready_to_checkpoint(spark)
    entries = listing(spark, root).checkpoint()
    rules = ignore_rules(entries, root, extra_rules, ios_preset)
    kept = entries.where(~P.ignored("path", rules)).where(~F.col("path").rlike("\\.xcassets/.+"))
    return kept.withColumn("stamp", F.concat_ws(":", F.col("size").cast("string"), F.col("mtime_ms").cast("string")))


def with_contents(named: DataFrame, root: str, size_cap: int = SIZE_CAP, whole: bool = False) -> DataFrame:
    """Listed files with their bytes, read by tasks, and the flags: rows of CATALOG.

    Of an oversized file in no known language only what is sniffed is read, since no step takes its text; the same holds
    beyond MOST_WHOLE bytes. Its flags come from these bytes and its content is null; with `whole` all are read. Files
    are read a few at a time. One that is gone by then has no row.
    """
    # names are dealt anew by their hash, so that a large folder is read by many tasks
    sampled = (F.col("size") > MOST_WHOLE) | ((F.col("size") > size_cap) & P.language("path").isNull() & F.lit(not whole))
    rows = named.select(F.lit(root).alias("root"), "path", "abs_path", "size", "mtime_ms", sampled.alias("sampled")).repartition("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = opened(root)[0]

        def read(part: pa.RecordBatch) -> pa.RecordBatch:
            contents, there = [], []
            for k, (path, few) in enumerate(zip(part.column(2).to_pylist(), part.column(5).to_pylist(), strict=True)):
                try:
                    with system.open_input_stream(path, compression=None) as source:
                        contents.append(source.read(SNIFF_BYTES) if few else source.read())
                    there.append(k)
                except FileNotFoundError:
                    continue
            left = part.take(pa.array(there, pa.int64()))
            return pa.RecordBatch.from_arrays([*left.columns, pa.array(contents, pa.large_binary())], names=[*left.schema.names, "content"]).cast(shape)

        for batch in batches:
            first, held = 0, 0
            for k, (size, few) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                cost = min(size, SNIFF_BYTES) if few else size
                if k > first and held + cost > READ_BYTES:
                    yield read(batch.slice(first, k - first))
                    first, held = k, 0
                held += cost
            yield read(batch.slice(first))

    shape = pa.schema([("root", pa.string()), ("path", pa.string()), ("abs_path", pa.string()), ("size", pa.int64()), ("mtime_ms", pa.float64()), ("sampled", pa.bool_()), ("content", pa.binary())])
    found = flagged(rows.mapInArrow(run, "root string, path string, abs_path string, size long, mtime_ms double, sampled boolean, content binary"), size_cap)
    return found.withColumn("content", F.when(~F.col("sampled"), F.col("content"))).drop("sampled")


def scan(spark: SparkSession, root: str, extra_rules: list[str] = (), ios_preset: bool | str = "auto", size_cap: int = SIZE_CAP) -> DataFrame:
    """All files below a folder, less the ignored ones, as with_contents() reads them."""
    return with_contents(listed(spark, root, extra_rules, ios_preset), root, size_cap)


def ignore_rules(entries: DataFrame, root: str, extra: list[str] = (), ios_preset: bool | str = "auto") -> list[str]:
    """The rules that hold for a listed folder: extra ones, the preset, then those of ignore files by depth. To the
    driver come the ignore files' paths and one sign of an iOS project."""
    system, base = opened(root)
    rules, name = list(extra), P.base_name("path")
    signs = entries.where(F.split_part("path", F.lit("/"), F.lit(1)).endswith(".xcodeproj") & F.contains("path", F.lit("/")) | (F.col("path") == "Package.swift")).limit(1).select("path")
    found = [r["path"] for r in entries.where(name.isin(IGNORE_FILES)).select("path").unionByName(signs).collect()]
    own = [p for p in found if p.rpartition("/")[2] in IGNORE_FILES]
    if ios_preset is True or (ios_preset == "auto" and len(own) < len(found)):
        rules += P.IOS_RULES
    for path in sorted(set(own), key=lambda p: (p.count("/"), p.rpartition("/")[0], IGNORE_FILES.index(p.rpartition("/")[2]))):
        with system.open_input_stream(f"{base}/{path}") as source:
            for line in source.read().decode("utf-8", "replace").splitlines():
                rules += P.rebased(path.rpartition("/")[0], line)
    return rules


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """The directories that the paths imply."""
    cut = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(cut) - 1), lambda i: F.array_join(F.slice(cut, F.lit(1), i), "/"))
    return files.where(F.size(cut) > 1).select(F.explode(above).alias("path")).distinct()


def freshness(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, fresh, current_mtime_ms): whether a file still has the time it had; null where it is gone."""
    current = now.select("path", F.col("mtime_ms").alias("current_mtime_ms"))
    return before.select("path", "mtime_ms").join(current, "path", "left").select("path", F.coalesce(F.col("mtime_ms") == F.col("current_mtime_ms"), F.lit(False)).alias("fresh"), "current_mtime_ms")


CATALOG = "root string, path string, abs_path string, size long, mtime_ms double, content binary, is_binary boolean, oversized boolean, likely_generated boolean, language string"


class Catalog:
    """A scanned folder in a versioned table: files whose size and time stay are not opened again, here or in a later
    session. It is looked at once, until what is held is said to have changed."""

    def __init__(self, spark: SparkSession, root: str, folder: str, extra_rules: list[str] = (), ios_preset: bool | str = "auto", size_cap: int = SIZE_CAP):
        self.spark, self.root, self.cap, self.rules = spark, root, size_cap, (list(extra_rules), ios_preset)
        self.table, self.looked = Versioned(spark, folder, CATALOG), False

    def refresh(self) -> dict[str, int]:
        """How many files were added, changed and removed since the version before; only these were read. What is kept
        under another root or size cap is dropped first, since the flags depend on them."""
        facts = {"root": self.root, "size_cap": self.cap}
        if self.table.manifest()["facts"] != facts:
            self.table.clear(facts)
        found = self.table.follow(listed(self.spark, self.root, *self.rules), lambda named: with_contents(named, self.root, self.cap))
        self.looked = True
        return found

    def files(self) -> DataFrame:
        if not self.looked:
            self.refresh()
        return self.table.read()

    def stamped(self) -> DataFrame:
        """files() with the stamp that they were read under."""
        return self.files().join(self.table.stamps(), "path")

    def drop(self) -> None:
        """The folder may have changed: the next use looks at it again."""
        self.looked = False
