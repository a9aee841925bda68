"""Running totals over an order, global or within groups, without one task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_PARTS = 64


def _parts(x: Column) -> tuple[Column, Column]:
    """A double as the sum of its upper and lower half of digits."""
    high = x * 134217729.0 - (x * 134217729.0 - x)
    return high, x - high


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once."""
    (ah, al), (bh, bl), p = _parts(a), _parts(b), a * b
    left = ((ah * bh - p) + ah * bl + al * bh) + al * bl  # a * b is p + left
    s = p + c
    off = (p - (s - (s - p))) + (c - (s - p))  # p + c is s + off
    return s + (off + left)


def interpolated(rows: DataFrame, value: str, share: float, by: list[str], name: str) -> DataFrame:
    """rows with `name`: the quantile of `value` (nulls left out) in the groups of `by`, to the last digit as DuckDB interpolates it: lower * (1 - d)
    + upper * d with one rounding of the sum, also between equal values, where Spark's percentile gives the value itself."""
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("_r", F.row_number().over(whole.orderBy(F.col(value).asc_nulls_last()))).withColumn("_at", (F.count(value).over(whole) - 1) * F.lit(share))
    pick = lambda k: F.max(F.when(F.col("_r") == k + 1, F.col(value))).over(whole)
    d = F.col("_at") - F.floor("_at")
    rows = rows.withColumn("_lo", pick(F.floor("_at"))).withColumn("_hi", pick(F.ceil("_at"))).withColumn("_d", d)
    both = fused(F.col("_lo"), 1 - F.col("_d"), F.col("_hi") * F.col("_d"))
    return rows.withColumn(name, F.when(F.col("_d") == 0, F.col("_lo")).otherwise(both)).drop("_r", "_at", "_lo", "_hi", "_d")


def running_totals(rows: DataFrame, key: str, sums: list[str], descending: bool = False, by: list[str] | None = None, ties: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with `<sum>_before`: the total of each of `sums` over rows of smaller `key`, a number (larger ones if descending),
    within the groups that the columns `by` make. Rows of equal key are put in order by `ties`.

    Quantiles of the key cut the order into ranges; ranges are summed, their totals accumulate, and only rows within a range of
    a group are put in order, so a group that holds most rows is spread over the ranges. There are as many ranges as shuffle
    partitions, and LEAST_PARTS at least, unless `parts` says otherwise.
    """
    by = by or []
    parts = parts or max(LEAST_PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    # how many cuts are below the key
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    placed = rows.withColumn("_part", -part if descending else part)
    totals = placed.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # at most `parts` rows of a group: the window is bounded
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    order = [F.col(key).desc() if descending else F.col(key).asc(), *(ties or [])]
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select(*placed.columns, *[F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"_w_{s}") for s in sums])
    if by:
        named = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_by_part"), *[f"_o_{s}" for s in sums])
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_part") == F.col("_by_part")]
        out = out.join(named, same).drop("_by_part", *[f"_by_{c}" for c in by])
    else:
        out = out.join(F.broadcast(totals), "_part")  # at most `parts` rows
    for s in sums:
        out = out.withColumn(f"{s}_before", F.col(f"_w_{s}") + F.col(f"_o_{s}"))
    return out.drop("_part", *[f"_o_{s}" for s in sums], *[f"_w_{s}" for s in sums])
