"""Ordered greedy choice under a budget: what does not fit is passed over, smaller rows after it may still fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(rows: Column, cost: str, budget: int, first_free: bool = False, separator: int = 0) -> Column:
    """The rows of an ordered array of structs that fit one after another.

    first_free: the first row is taken whatever it costs. separator: what each row after the first costs besides.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter(rows, lambda _: F.lit(False)).alias("kept"))

    def step(state: Column, row: Column) -> Column:
        used = state["used"] + row[cost] + F.when(F.size(state["kept"]) > 0, F.lit(separator)).otherwise(F.lit(0))
        fits = used <= budget
        if first_free:
            fits = fits | (F.size(state["kept"]) == 0)
        return F.struct(F.when(fits, used).otherwise(state["used"]).cast("long").alias("used"), F.when(fits, F.concat(state["kept"], F.array(row))).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(rows, start, step, lambda s: s["kept"])


def choose(rows: DataFrame, order: list[str], cost: str, budget: int, limit: int, group: list[str] | None = None, first_free: bool = False, separator: int = 0) -> DataFrame:
    """The first `limit` rows of each group by `order` (ascending columns), reduced to what fits the budget.

    Only the rows within the limit meet in one task, so the fold never sees an unbounded group. Adds `position`.
    """
    from pyspark.sql import Window

    keys = group or []
    if keys:
        top = rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= limit)
    else:
        top = rows.orderBy(*order).limit(limit)
        top = top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    whole = F.struct("position", *[c for c in top.columns if c not in keys and c != "position"])
    folded = top.groupBy(*keys).agg(F.array_sort(F.collect_list(whole)).alias("_rows"))
    kept = folded.select(*keys, F.explode(greedy(F.col("_rows"), cost, budget, first_free, separator)).alias("_r"))
    return kept.select(*keys, "_r.*")
