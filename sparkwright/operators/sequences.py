"""Sequence operators over intervals: rows (key, i, rr) with i = 0, 1, ... within each key.

All are windows partitioned by key or aggregates over it, so a plan needs one exchange by key, whatever is stacked on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.operators.ordering import interpolated


def by_key() -> Window:
    return Window.partitionBy("key")


def in_order() -> Window:
    return by_key().orderBy("i")


def intervals(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """(key, i, ts, us): microseconds since the key's event before, from its second event on."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    step = events.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.lag(ts).over(order).alias("before"), (F.row_number().over(order) - 2).cast("long").alias("i"))
    return step.where("i >= 0").select("key", "i", "ts", F.expr("timestampdiff(MICROSECOND, before, ts)").alias("us"))


def hrv(rows: DataFrame) -> DataFrame:
    """mean, SDNN (population), RMSSD, pNN50 (differences of at least 50, in per cent of differences) and CV of each key."""
    d = rows.withColumn("d", F.col("rr") - F.lag("rr").over(in_order()))
    big = F.when(F.abs("d") >= 50, 1).when(F.col("d").isNotNull(), 0)
    out = d.groupBy("key").agg(F.count("rr").alias("n"), F.avg("rr").alias("mean"), F.stddev_pop("rr").alias("sdnn"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), (100 * F.avg(big)).alias("pnn50"))
    return out.withColumn("cv", F.try_divide("sdnn", "mean"))


def mad_trim(rows: DataFrame, low: float = 300, high: float = 2000, width: float = 3.5) -> DataFrame:
    """rows within hard bounds and within `width` scaled median absolute deviations of their key's median."""
    kept = rows.where(F.col("rr").between(low, high))
    med = kept.withColumn("med", F.percentile("rr", F.lit(0.5)).over(by_key()))
    mad = med.withColumn("mad", F.percentile(F.abs(F.col("rr") - F.col("med")), F.lit(0.5)).over(by_key()))
    return mad.where(F.abs(F.col("rr") - F.col("med")) <= width * 1.4826 * (F.col("mad") + 1e-9)).drop("med", "mad")


def low_median_filter(rows: DataFrame, tolerance: float) -> DataFrame:
    """rows within tolerance of their key's lower median (an element, not a mean of two)."""
    rank = F.row_number().over(by_key().orderBy("rr", "i"))
    middle = F.ceil(F.count("*").over(by_key()) / 2)
    placed = rows.withColumn("mid", F.when(rank == middle, F.col("rr")))
    return placed.withColumn("mid", F.max("mid").over(by_key())).where(F.abs(F.col("rr") - F.col("mid")) <= tolerance).drop("mid")


def sliding_windows(rows: DataFrame, size: float = 10_000, step: float = 2_000, least: int = 4) -> DataFrame:
    """(key, w, n, mean, cv, pnn50) of each window of `size` every `step` over accumulated time: an interval counts if it
    lies inside; windows with fewer than `least` intervals are left out. Each interval is copied to its windows only."""
    ends = rows.withColumn("t1", F.sum("rr").over(in_order())).withColumn("t0", F.col("t1") - F.col("rr"))
    total = ends.withColumn("all", F.max("t1").over(by_key()))
    first = F.greatest(F.lit(0), F.ceil((F.col("t1") - size) / step)).cast("long")
    last = F.floor(F.col("t0") / step).cast("long")
    fits = F.floor(F.greatest(F.col("all") - size, F.lit(0.0)) / step).cast("long")
    last = F.least(last, fits)
    each = total.where(first <= last).withColumn("w", F.explode(F.sequence(first, last)))
    order = Window.partitionBy("key", "w").orderBy("i")
    d = each.withColumn("d", F.col("rr") - F.lag("rr").over(order))
    big = F.when(F.abs("d") >= 50, 1).when(F.col("d").isNotNull(), 0)
    out = d.groupBy("key", "w").agg(F.count("*").alias("n"), F.avg("rr").alias("mean"), F.stddev_pop("rr").alias("sd"), (100 * F.avg(big)).alias("pnn50"))
    return out.where(F.col("n") >= least).select("key", "w", "n", "mean", F.try_divide("sd", "mean").alias("cv"), "pnn50")


def regularity(cv: Column, pnn50: Column) -> tuple[Column, Column]:
    """(regular, irregular); both false without a coefficient of variation."""
    p = F.coalesce(pnn50, F.lit(0.0))
    return F.coalesce((cv <= 0.08) & (p <= 10), F.lit(False)), F.coalesce((cv >= 0.12) | (p >= 20), F.lit(False))


def panorama() -> Column:
    """Tokens of a key from columns reg and irr (shares of its windows), k and separation, bpm, ratio, cycle, pvcs and pacs."""
    c = F.col
    return F.array_compact(F.array(
        F.when((c("irr") >= 0.6) & (c("k") == 1), "AAR").when((c("irr") >= 0.5) & (c("k") >= 2) & (c("separation") < 1.5), "HIR").when(c("reg") >= 0.6, "REG"),
        F.when((c("reg") >= 0.6) & (c("bpm") >= 100), "STA").when((c("reg") >= 0.6) & (c("bpm") < 60), "LRR"),
        c("ratio"), c("cycle"), F.when(c("pvcs") >= 3, "PVCx"), F.when(c("pacs") >= 3, "PACx"),
    ))


def premature(rows: DataFrame, least: int = 5) -> DataFrame:
    """Counts of premature ventricular and atrial intervals of each key with at least `least` intervals.

    pvcs and pacs follow the rule as it is coded: short and long are asked of one and the same interval, so both are 0.
    pvcs_next and pacs_next ask the next interval to be long.
    """
    m = rows.withColumn("med", F.percentile("rr", F.lit(0.5)).over(by_key())).withColumn("next", F.lead("rr").over(in_order()))
    short, mild = F.col("rr") < 0.8 * F.col("med"), (F.col("rr") < 0.9 * F.col("med")) & (F.col("rr") >= 0.8 * F.col("med"))
    long, pause = lambda c: F.col(c) > 1.2 * F.col("med"), lambda c: F.col(c) > 1.05 * F.col("med")
    later = F.col("i") > 0
    counts = [
        F.count_if(short & later & long("rr")).alias("pvcs"), F.count_if(mild & later & pause("rr")).alias("pacs"),
        F.count_if(short & long("next")).alias("pvcs_next"), F.count_if(mild & pause("next")).alias("pacs_next"),
    ]
    return m.groupBy("key").agg(F.count("*").alias("n"), *counts).where(F.col("n") >= least)


def short_long_short(rows: DataFrame) -> DataFrame:
    """(key, i) of the first interval of each short, long, short triplet."""
    m = rows.withColumn("med", F.percentile("rr", F.lit(0.5)).over(by_key()))
    a, b, c = F.col("rr"), F.lead("rr", 1).over(in_order()), F.lead("rr", 2).over(in_order())
    flagged = m.withColumn("hit", (a < 0.8 * F.col("med")) & (b > 1.2 * F.col("med")) & (c < 0.8 * F.col("med")))
    return flagged.where("hit").select("key", "i")


def ratio_shares(rows: DataFrame, ratios: tuple[float, ...] = (1, 1.5, 2, 3, 4), near: float = 0.1) -> DataFrame:
    """(key, r1, r1_5, ...): share of intervals within `near` of each ratio to the key's 10th percentile, to six digits as SQL rounds them: the
    number times a million to the nearest whole, which may differ from rounding its decimals where they end in 5."""
    base = interpolated(rows, "rr", 0.1, ["key"], "b")
    share = lambda x: F.floor(F.avg((F.abs(F.col("rr") / F.col("b") - x) <= near).cast("int")) * 1e6 + 0.5) / 1e6
    return base.groupBy("key").agg(*[share(x).alias(f"r{str(x).replace('.', '_')}") for x in ratios])


def paired(rows: DataFrame, ratio: float = 0.8, least: int = 3, share: float = 0.75) -> DataFrame:
    """Bigeminy: even pairs whose first is shorter than ratio times the second."""
    pair = rows.groupBy("key", F.floor(F.col("i") / 2).alias("p")).agg(F.max_by("rr", -F.col("i")).alias("a"), F.max_by("rr", "i").alias("b"), F.count("*").alias("n"))
    out = pair.where("n = 2").groupBy("key").agg(F.count("*").alias("pairs"), F.count_if(F.col("a") < ratio * F.col("b")).alias("hits"))
    return out.withColumn("present", (F.col("pairs") >= least) & (F.col("hits") >= share * F.col("pairs")))


def tripled(rows: DataFrame, ratio: float = 0.8, least: int = 2, share: float = 0.67) -> DataFrame:
    """Trigeminy: triples whose third is shorter than ratio times the mean of the first two."""
    place = F.col("i") % 3
    triple = rows.groupBy("key", F.floor(F.col("i") / 3).alias("p")).agg(F.avg(F.when(place < 2, F.col("rr"))).alias("m"), F.max(F.when(place == 2, F.col("rr"))).alias("c"), F.count("*").alias("n"))
    out = triple.where("n = 3").groupBy("key").agg(F.count("*").alias("triples"), F.count_if(F.col("c") < ratio * F.col("m")).alias("hits"))
    return out.withColumn("present", (F.col("triples") >= least) & (F.col("hits") >= share * F.col("triples")))


def islands(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """rows with `island`: a number that changes where value does, in order of i within the keys."""
    order = Window.partitionBy(*keys).orderBy("i")
    new = F.when(F.lag(value).over(order).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order)).drop("_new")


def value_runs(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, start, n) of each maximal run of equal values."""
    return islands(rows, value, *keys).groupBy(*keys, "island", value).agg(F.min("i").alias("start"), F.count("*").alias("n")).drop("island")


def long_pause(rows: DataFrame) -> DataFrame:
    """The longest interval against twice the mean or 2000 ms, with the grade of a pause (none without one)."""
    out = rows.groupBy("key").agg(F.max("rr").alias("longest"), F.avg("rr").alias("mean"))
    out = out.withColumn("present", (F.col("longest") > 2 * F.col("mean")) | (F.col("longest") > 2000))
    grade = F.when(~F.col("present"), "none").when(F.col("longest") > 3000, "critical").when(F.col("longest") > 2500, "severe").when(F.col("longest") > 2000, "significant").otherwise("moderate")
    return out.select("key", "longest", "present", grade.alias("grade"))


def return_map(rows: DataFrame, label: str) -> DataFrame:
    """Share of the two most frequent (label, next label) pairs of each key."""
    pairs = rows.withColumn("b", F.lead(label).over(in_order())).where(F.col("b").isNotNull())
    counts = pairs.groupBy("key", label, "b").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(by_key().orderBy(F.desc("n"), label, "b")))
    return top.groupBy("key").agg(F.sum("n").alias("pairs"), (F.sum(F.when(F.col("r") <= 2, F.col("n"))) / F.sum("n")).alias("share"))


def histogram(rows: DataFrame, width: float) -> DataFrame:
    """(key, bin, n), empty bins left out."""
    return rows.groupBy("key", F.floor(F.col("rr") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def histogram_peaks(rows: DataFrame, width: float, height: float = 0.35, least: int = 3) -> DataFrame:
    """Bins higher than both neighbours (an empty bin counts 0), of at least height times the highest and `least` rows."""
    order = by_key().orderBy("bin").rangeBetween(-1, -1)
    after = by_key().orderBy("bin").rangeBetween(1, 1)
    h = histogram(rows, width).withColumn("l", F.coalesce(F.max("n").over(order), F.lit(0))).withColumn("r", F.coalesce(F.max("n").over(after), F.lit(0)))
    h = h.withColumn("top", F.max("n").over(by_key()))
    return h.where((F.col("n") > F.col("l")) & (F.col("n") > F.col("r")) & (F.col("n") >= height * F.col("top")) & (F.col("n") >= least)).select("key", "bin", "n")


def nearest_center(rows: DataFrame, centers: DataFrame, tolerance: float) -> DataFrame:
    """rows with the index `c` of their key's nearest center (first of equals) within tolerance, else null; centers are
    (key, c, center)."""
    packed = centers.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "center"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda x: F.struct(F.abs(x["center"] - F.col("rr")).alias("d"), x["c"].alias("c"))))
    out = rows.join(packed, "key", "left").withColumn("near", near)
    return out.withColumn("c", F.when(F.col("near.d") <= tolerance, F.col("near.c"))).drop("near", "cs")


def acf(rows: DataFrame, lags: int = 4, least: int = 5) -> DataFrame:
    """(key, lag, acf): autocorrelation by position; 0 with fewer than `least` values, hardly any variance, or under 4 pairs."""
    m = rows.withColumn("m", F.avg("rr").over(by_key())).withColumn("v", F.var_pop("rr").over(by_key())).withColumn("n", F.count("*").over(by_key()))
    for k in range(1, lags + 1):
        m = m.withColumn(f"x{k}", (F.lag("rr", k).over(in_order()) - F.col("m")) * (F.col("rr") - F.col("m")))
    terms = [F.struct(F.lit(k).alias("lag"), F.col(f"x{k}").alias("x")) for k in range(1, lags + 1)]
    each = m.select("key", "n", "v", F.explode(F.array(*terms)).alias("t"))
    out = each.groupBy("key", "t.lag").agg(F.first("n").alias("n"), F.first("v").alias("v"), F.sum("t.x").alias("s"), F.count("t.x").alias("pairs"))
    value = F.when((F.col("n") < least) | (F.col("v") < 1e-12) | (F.col("pairs") < 4), 0.0).otherwise(F.col("s") / (F.col("n") * F.col("v")))
    return out.select("key", "lag", value.alias("acf"))


def robust(rows: DataFrame, *keys: str) -> DataFrame:
    """n, median, unscaled MAD and interquartile range of rr for each group of keys."""
    own = Window.partitionBy(*keys)
    med = rows.withColumn("med", F.percentile("rr", F.lit(0.5)).over(own))
    q = lambda x: F.percentile("rr", F.lit(x))
    return med.groupBy(*keys).agg(F.count("rr").alias("n"), F.first("med").alias("median"), F.percentile(F.abs(F.col("rr") - F.col("med")), F.lit(0.5)).alias("mad"), (q(0.75) - q(0.25)).alias("iqr"))


def dft_alternation(rows: DataFrame, periods: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """For each key and period p: the amplitude of the centred values at period p over MAD; 0 with fewer than 2p values or
    a MAD below its floor."""
    s = robust(rows, "key")
    both = rows.join(s, "key")
    each = both.withColumn("p", F.explode(F.array(*[F.lit(p) for p in periods])))
    angle = 2 * F.pi() * F.col("i") / F.col("p")
    x = F.col("rr") - F.col("median")
    out = each.groupBy("key", "p").agg(F.first("n").alias("n"), F.first("median").alias("med"), F.first("mad").alias("mad"), F.sum(x * F.cos(angle)).alias("re"), F.sum(x * F.sin(angle)).alias("im"))
    floor = F.greatest(0.01 * F.greatest(F.abs("med"), F.lit(1e-3)), F.lit(1e-3))
    value = F.when((F.col("n") < 2 * F.col("p")) | (F.col("mad") < floor), 0.0).otherwise(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.col("n") / F.col("mad"))
    return out.select("key", "p", value.alias("index"))


def circular(rows: DataFrame, angle: str, *keys: str) -> DataFrame:
    """Mean direction in degrees and resultant length of each group."""
    a = F.radians(angle)
    out = rows.groupBy(*keys).agg(F.avg(F.sin(a)).alias("s"), F.avg(F.cos(a)).alias("c"), F.count("*").alias("n"))
    return out.select(*keys, "n", F.degrees(F.atan2("s", "c")).alias("mean"), F.sqrt(F.col("s") ** 2 + F.col("c") ** 2).alias("length"))


def wrap(angle: Column) -> Column:
    """An angle in degrees in [-180, 180)."""
    return F.pmod(angle + 180, F.lit(360.0)) - 180


def weighted_median(rows: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """The first value at which the running weight reaches half of all weight."""
    own = Window.partitionBy(*keys)
    run = F.sum(weight).over(own.orderBy(value, "i").rowsBetween(Window.unboundedPreceding, 0))
    half = rows.withColumn("run", run).withColumn("half", F.sum(weight).over(own) / 2)
    return half.where("run >= half").groupBy(*keys).agg(F.min(value).alias("median"))


def weighted_quantile(rows: DataFrame, value: str, weight: str, q: float, *keys: str) -> DataFrame:
    """Linear interpolation of value on the normalised running weight; equal weights where they sum to 0."""
    own = Window.partitionBy(*keys)
    order = own.orderBy(value, "i")
    total = F.sum(weight).over(own)
    w = F.when(total > 0, F.col(weight)).otherwise(F.lit(1.0))
    cdf = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(own)
    placed = rows.withColumn("w", w.cast("double")).withColumn("cdf", cdf)
    placed = placed.withColumn("c0", F.lag("cdf").over(order)).withColumn("v0", F.lag(value).over(order))
    hit = placed.where((F.col("cdf") >= q) & (F.coalesce("c0", F.lit(-1.0)) < q))
    inside = F.col("v0") + (F.col(value) - F.col("v0")) * F.try_divide(F.lit(q) - F.col("c0"), F.col("cdf") - F.col("c0"))
    return hit.groupBy(*keys).agg(F.min(F.coalesce(inside, F.col(value))).alias("quantile"))


def entropy(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Shannon entropy (natural logarithm) of the equal-width histogram of each key; 0 where all values are equal."""
    lo, hi = F.min("rr").over(by_key()), F.max("rr").over(by_key())
    bound = rows.withColumn("lo", lo).withColumn("hi", hi)
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("rr") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    counts = bound.withColumn("b", b).groupBy("key", "b").agg(F.count("*").alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(by_key()))
    return share.groupBy("key").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.sum("n").alias("n"))


def merge_while(rows: DataFrame, ok: Column, *keys: str) -> DataFrame:
    """rows with `island`: a new one begins where `ok`, a test against the row before, is false or null."""
    order = Window.partitionBy(*keys).orderBy("i")
    return rows.withColumn("_new", F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(order)).drop("_new")


def newest_within(rows: DataFrame, cost: Column, budget: float, *keys: str) -> DataFrame:
    """The newest rows of each key (largest i first) up to, not including, the first that would exceed the budget."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(newest)).where(F.col("used") <= budget)


def clipped_share(rows: DataFrame, least: int = 3, tolerance: float = 0.001) -> DataFrame:
    """(key, clipped): the share of values in runs of at least `least` next to the key's minimum, and next to its maximum; 0 with
    fewer than 16 values."""
    lo, hi = F.min("rr").over(by_key()), F.max("rr").over(by_key())
    b = rows.withColumn("lo", lo).withColumn("span", hi - lo + 1e-9).withColumn("n", F.count("*").over(by_key()))
    near = F.when(F.col("rr") - F.col("lo") < tolerance * F.col("span"), 1).when(F.col("lo") + F.col("span") - F.col("rr") < tolerance * F.col("span"), 2).otherwise(0)
    runs = value_runs(b.withColumn("side", near), "side", "key")
    out = runs.groupBy("key").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when((F.col("side") > 0) & (F.col("n") >= least), F.col("n"))), F.lit(0)).alias("held"))
    return out.select("key", F.when(F.col("n") < 16, 0.0).otherwise(F.col("held") / F.col("n")).alias("clipped"))


def flat_share(rows: DataFrame, size: int) -> DataFrame:
    """(key, flat): the share of windows of `size` values, half a window apart, whose deviation is below 0.005 of the key's span and
    0.015 at least; 0 with fewer than two windows' values."""
    step = size // 2
    span = F.max("rr").over(by_key()) - F.min("rr").over(by_key()) + 1e-9
    ahead = in_order().rowsBetween(0, size - 1)
    own = rows.withColumn("least", F.greatest(0.005 * span, F.lit(0.015))).withColumn("n", F.count("*").over(by_key()))
    each = own.withColumn("sd", F.stddev_pop("rr").over(ahead)).withColumn("held", F.count("*").over(ahead)).withColumn("starts", (F.col("held") == size) & (F.col("i") % step == 0) & (F.col("n") >= 2 * size))
    flat = F.coalesce(F.avg(F.when(F.col("starts"), (F.col("sd") < F.col("least")).cast("int"))), F.lit(0.0))
    return each.groupBy("key").agg(flat.alias("flat"))
