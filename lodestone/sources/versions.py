"""Tables of rows by path that are brought up to date by what has changed, and whose versions are swapped as a whole.

A part is a folder that is written once: rows, and a mark (path, stamp, gone) for each path that the part speaks for. A
path's rows are those of the last part that speaks for it, so a mark alone takes a path out. A manifest names the parts
of a version; it takes its numbered name only when it is whole, and the highest number holds. Readers keep to the
manifest that they began with; what failed jobs leave is named by none. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow.fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ordering import ready_to_checkpoint

MARK = "path string, stamp string, gone boolean"
#: Parts after the first that are merged into one, and manifests that stay readable after a swap.
MOST_PARTS, KEPT = 8, 2


def opened(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder, and the folder's path there."""
    system, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    return system, base.rstrip("/")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, stamp, change) of two tables of (path, stamp): `added`, `changed` or `removed`; what stays has no row.

    A path stands once on each side and is not null; a null stamp equals a null stamp only.
    """
    was, is_ = (side.select("path", F.struct("stamp").alias(name)) for side, name in ((before, "_was"), (now, "_is")))
    change = F.when(F.col("_was").isNull(), F.lit("added")).when(F.col("_is").isNull(), F.lit("removed")).when(~F.col("_was.stamp").eqNullSafe(F.col("_is.stamp")), F.lit("changed"))
    return was.join(is_, "path", "full").select("path", F.coalesce("_is", "_was")["stamp"].alias("stamp"), change.alias("change")).where("change IS NOT NULL")


class Versioned:
    """A table in a folder that the driver and all executors share. schema: path and the other columns, as DDL."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.system, self.base = opened(self.folder)

    def _named(self, prefix: str) -> list[str]:
        found = self.system.get_file_info(pyarrow.fs.FileSelector(self.base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.startswith(prefix))

    def manifest(self, name: str | None = None) -> dict:
        """The version that holds now: number, parts (name, number, paths) and facts."""
        names = [name] if name else self._named("manifest-")
        if not names:
            return {"number": 0, "parts": [], "facts": {}}
        with self.system.open_input_stream(f"{self.base}/{names[-1]}") as source:
            return json.loads(source.read())

    def _swap(self, parts: list[dict], facts: dict) -> None:
        number = self.manifest()["number"] + 1
        self.system.create_dir(self.base, recursive=True)
        ahead = f"{self.base}/.ahead-{uuid.uuid4().hex}"
        with self.system.open_output_stream(ahead) as out:
            out.write(json.dumps({"number": number, "parts": parts, "facts": facts}).encode())
        self.system.move(ahead, f"{self.base}/manifest-{number:012d}.json")

    def _marks(self, parts: list[dict]) -> DataFrame:
        """The last mark of each path."""
        if not parts:
            return self.spark.createDataFrame([], f"{MARK}, part long")
        rows = self.spark.read.schema(f"{MARK}, part long").parquet(*[f"{self.folder}/{p['name']}/marks" for p in parts])
        return rows if len(parts) == 1 else rows.groupBy("path").agg(F.max_by(F.struct("stamp", "gone", "part"), "part").alias("_m")).select("path", "_m.*")

    def stamps(self) -> DataFrame:
        """(path, stamp) of what the table holds."""
        return self._marks(self.manifest()["parts"]).where("NOT gone").select("path", "stamp")

    def _rows(self, parts: list[dict], over: list[dict]) -> DataFrame:
        """The rows of `parts` of which no later part of `over` speaks. Only marks meet; rows move where marks are many."""
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, part long")
        rows = self.spark.read.schema(f"{self.schema}, part long").parquet(*[f"{self.folder}/{p['name']}/rows" for p in parts])
        if not over:
            return rows
        last = self._marks(over).select("path", F.col("part").alias("_last"))
        return rows.join(last, "path", "left").where("_last IS NULL OR part = _last").drop("_last")

    def read(self) -> DataFrame:
        parts = self.manifest()["parts"]
        return self._rows(parts, parts[1:]).drop("part")

    def _write(self, rows: DataFrame, marks: DataFrame, number: int) -> dict:
        name, seen = f"part-{uuid.uuid4().hex}", Observation()
        rows.withColumn("part", F.lit(number).cast("long")).write.parquet(f"{self.folder}/{name}/rows")
        marks.select("path", "stamp", "gone", F.lit(number).cast("long").alias("part")).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.folder}/{name}/marks")
        return {"name": name, "number": number, "paths": seen.get["n"]}

    def add(self, rows: DataFrame, marks: DataFrame, facts: dict | None = None) -> None:
        """A new version: `rows` replace all rows of the paths that `marks` (path, stamp, gone) names."""
        now = self.manifest()
        part = self._write(rows.select(*self.spark.createDataFrame([], self.schema).columns), marks, 1 + max([p["number"] for p in now["parts"]], default=-1))
        self._swap([*now["parts"], part], now["facts"] if facts is None else facts)
        self.compact()
        self.clean()

    def clear(self, facts: dict) -> None:
        """A new version without rows."""
        self._swap([], facts)

    def compact(self) -> None:
        """Merges parts: all after the first once there are many, and these with the first once they speak for half as
        many paths, so that a path is written again a bounded number of times on average."""
        now = self.manifest()
        first, later = now["parts"][:1], now["parts"][1:]
        whole = bool(later) and 2 * sum(p["paths"] for p in later) > first[0]["paths"]
        if not whole and len(later) <= MOST_PARTS:
            return
        parts = now["parts"] if whole else later
        marks = self._marks(parts).where("NOT gone") if whole else self._marks(parts)
        merged = self._write(self._rows(parts, parts[1:]).drop("part"), marks, parts[-1]["number"])
        self._swap([merged] if whole else [*first, merged], now["facts"])

    def clean(self) -> None:
        """Removes manifests but the last ones, and the parts that these do not name."""
        manifests = self._named("manifest-")
        named = {p["name"] for m in manifests[-KEPT:] for p in self.manifest(m)["parts"]}
        for name in manifests[:-KEPT]:
            self.system.delete_file(f"{self.base}/{name}")
        for name in set(self._named("part-")) - named:
            self.system.delete_dir(f"{self.base}/{name}")

    def follow(self, now: DataFrame, make: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Brings the table up to `now` (path, stamp and what make needs) and says how many paths were added, changed
        and removed. make(the rows of `now` that are new or changed) gives their rows here; no other is worked on."""
        ready_to_checkpoint(self.spark)
        due = changes(self.stamps(), now.select("path", "stamp")).checkpoint()
        counts = dict.fromkeys(("added", "changed", "removed"), 0) | {r["change"]: r["count"] for r in due.groupBy("change").count().collect()}
        if any(counts.values()):
            fresh = now.join(due.where("change <> 'removed'").select("path"), "path", "left_semi")
            self.add(make(fresh), due.select("path", "stamp", (F.col("change") == "removed").alias("gone")))
        return counts
