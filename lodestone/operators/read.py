"""Reading parts of files: line ranges and batches under a shared cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def refusal() -> Column:
    """The error struct for files that are not read, null for others."""
    def error(code: str, message: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))

    return F.when(F.col("is_binary"), error("binary", "binary files are not read")).when(F.col("oversized"), error("too_large", "the file exceeds the size cap"))


def slice_lines(files: DataFrame, start: Column | int = 1, limit: Column | int | None = None, content: str = "content") -> DataFrame:
    """files with slice, total_lines, first_line and last_line instead of the content.

    start counts from 1 (0 is 1); a negative start takes that many lines from the end and no limit.
    """
    start = F.lit(start) if isinstance(start, int) else start
    rows = files.withColumn("_lines", T.lines_kept(content))
    n = F.size("_lines")
    first = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(F.greatest(start, F.lit(1)) - 1)
    count = n if limit is None else F.when(start < 0, n).otherwise(F.lit(limit) if isinstance(limit, int) else limit)
    rows = rows.withColumn("_first", first).withColumn("_count", F.greatest(F.lit(0), F.least(count, n - F.col("_first"))))
    cut = F.slice("_lines", F.col("_first") + 1, F.col("_count"))
    return rows.select(
        *[c for c in files.columns if c != content], F.array_join(cut, "").alias("slice"), n.alias("total_lines"), (F.col("_first") + 1).alias("first_line"), (F.col("_first") + F.col("_count")).alias("last_line")
    )


def read_batch(requests: DataFrame, files: DataFrame, max_chars: int, content: str = "content") -> DataFrame:
    """requests (request_idx, path) with each file's text up to an equal share of max_chars, and what was omitted.

    Paths without a file share in the cap too and come back with found = false. The number of requests is counted
    once; order by request_idx for the order of asking.
    """
    share = max_chars // max(1, requests.count())
    joined = requests.join(files.select("path", content, F.lit(True).alias("_found")), "path", "left")
    chars = T.utf16_length(F.coalesce(content, F.lit("")))
    return joined.select(
        "request_idx", "path", F.coalesce("_found", F.lit(False)).alias("found"), F.substring(content, 1, share).alias("text"), F.greatest(chars - share, F.lit(0)).alias("omitted"), (chars > share).alias("truncated")
    )
