"""Catalogs of labelled records: search, paging, multi-label filters, label-set algebra, merges and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(rows: DataFrame, source: str | None = None, label: str | None = None, text: str | None = None) -> DataFrame:
    """rows (id, source, labels, primary) by source, by label (in labels or primary) and by part of the id, in any case."""
    out = rows
    if source is not None:
        out = out.where(F.lower("source") == source.lower())
    if label is not None:
        own = F.exists("labels", lambda x: F.lower(x) == label.lower()) | (F.lower("primary") == label.lower())
        out = out.where(F.coalesce(own, F.lit(False)))
    if text is not None:
        out = out.where(F.lower(F.col("id").cast("string")).contains(text.lower()))
    return out


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page; the limit is held to 1 to 500 and the offset to 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; blank keys go. A key's rows meet by a map-side maximum, not by a sorted group."""
    named = rows.where(F.trim(F.col(key)) != "")
    packed = named.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r"))
    return packed.select(key, "r.*")


def fill_from(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """left with columns from right where right has them and they are not blank, else left's own."""
    other = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    use = lambda c: F.coalesce(F.when(F.trim(F.col(f"_{c}").cast("string")) != "", F.col(f"_{c}")), F.col(c))
    out = left.join(other, key, "left")
    return out.select(*[use(c).alias(c) if c in columns else F.col(c) for c in left.columns])


def single_filter(labels: Column, highlighted: str | None = None, filled: list[str] | None = None) -> Column:
    """Highlighted: the label is there. Filled: every label is among the filled ones, so rows without labels pass."""
    if highlighted is not None:
        return F.array_contains(labels, highlighted)
    allowed = F.array(*[F.lit(x) for x in filled or []]).cast("array<string>")
    return F.forall(labels, lambda x: F.array_contains(allowed, x))


def group_filter(labels: Column, items: list[tuple[str, str, int]], operators: dict[tuple[str, str], str]) -> Column:
    """Two or more selected labels: items are (label, 'filled' or 'highlighted', count).

    They are put in order (filled first, then by count), neighbours joined by AND form a group, and a row passes if it has
    all labels of any group; a group of filled labels only must be the row's whole set.
    """
    order = sorted(items, key=lambda x: (x[1] != "filled", -x[2], x[0]))
    groups = [[order[0]]]
    for before, now in zip(order, order[1:], strict=False):
        if operators.get((before[0], now[0]), "or") == "and":
            groups[-1].append(now)
        else:
            groups.append([now])
    passed = F.lit(False)
    for group in groups:
        has = F.lit(True)
        for label, _, _ in group:
            has = has & F.array_contains(labels, label)
        if all(state == "filled" for _, state, _ in group):
            has = has & (F.size(F.array_distinct(labels)) == len(group))
        passed = passed | has
    return passed


def next_state(state: str, seen: bool) -> tuple[str, bool]:
    """The cycle of a label's filter: off, highlighted, filled, highlighted again, off."""
    return {("off", False): ("highlighted", False), ("highlighted", False): ("filled", True), ("filled", True): ("highlighted", True), ("highlighted", True): ("off", False)}[(state, seen)]


def error_bucket(gold: Column, preds: Column, scored: Column) -> Column:
    """both, over, missed or match by the labels that are scored; na without any scored class."""
    own = F.array_intersect(gold, scored)
    over, missed = F.size(F.array_except(preds, own)) > 0, F.size(F.array_except(own, preds)) > 0
    return F.when(F.size(scored) == 0, "na").when(over & missed, "both").when(over, "over").when(missed, "missed").otherwise("match")


def exact_match(gold: Column, preds: Column, scored: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_intersect(gold, scored))) == F.array_sort(F.array_distinct(preds))


def folded_counts(rows: DataFrame, column: str, private: list[str], bucket: str = "private") -> DataFrame:
    name = F.when(F.col(column).isin(private), F.lit(bucket)).otherwise(F.coalesce(F.col(column), F.lit("unknown")))
    return rows.groupBy(name.alias(column)).agg(F.count("*").alias("n"))


def integrity(left: DataFrame, right: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows of left without a match, of right without a match, matched rows whose payloads differ, repeated keys of right."""
    a, b = left.select(key, F.col(payload).alias("p")), right.select(F.col(key).alias("k2"), F.col(payload).alias("q"))
    both = a.join(b, F.col(key) == F.col("k2"), "full_outer")
    out = both.agg(
        F.count_if(F.col("k2").isNull()).alias("missing"), F.count_if(F.col(key).isNull()).alias("extra"),
        F.count_if(F.col(key).isNotNull() & F.col("k2").isNotNull() & ~F.col("p").eqNullSafe(F.col("q"))).alias("differ"),
    )
    repeated = right.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated"))
    return out.join(F.broadcast(repeated))  # one row each


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def ranked_within(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
