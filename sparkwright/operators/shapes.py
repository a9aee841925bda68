"""Shapes of the T and QRS waves of leads, from their components in order: array functions over the few components of a lead, then quorums of
leads in one aggregate by recording.

Components are (rec, lead, wave, amp, center, sigma) of mean beats, in mV and ms. A lead without a wave does not meet its rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.signals import LEADS
from sparkwright.operators.rules import quorum

#: Name of a shape, how many leads must have it, among which, and whether they must be neighbours.
SHAPES = {
    "t_notched": (2, tuple(LEADS), True), "t_split": (2, tuple(LEADS), True), "t_plateau": (2, tuple(LEADS), True), "t_u_on_t": (2, tuple(LEADS), True),
    "rsr_pattern": (1, ("V1", "V2"), False), "splintered": (2, tuple(LEADS), False), "prominent_s": (2, ("I", "aVL", "V5", "V6"), False),
    "m_shape": (1, ("V1",), False), "slurred_s": (1, ("I", "V6"), False),
}
#: Step in ms at which the sum of bells is looked at between two of them.
GRID = 2
#: Smallest cosine over sine of an angle that a double of radians tells from a right one; Java's arctangent may be a digit off there.
RIGHT_ANGLE = 4.979e-17


def _parts(wave: str) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("wave") == wave, F.struct("center", "amp", "sigma"))))


def _notch(a: Column, b: Column) -> Column:
    """Two bells of one sign, 0.10 mV each and 40 ms apart, between which the sum of all bells falls to 70 % of the higher one."""
    low, high = F.least(a["center"], b["center"]), F.greatest(a["center"], b["center"])
    at = F.sequence(F.lit(0), F.floor((high - low) / GRID).cast("int"))
    value = lambda x: F.aggregate("ts", F.lit(0.0), lambda s, g: s + g["amp"] * F.exp(-0.5 * F.pow((x - g["center"]) / F.greatest(F.lit(1.0), g["sigma"]), 2)))
    valley = F.abs(F.array_min(F.transform(at, lambda i: value(low + i * GRID))))
    apart = (a["amp"] * b["amp"] > 0) & (F.abs(a["amp"]) >= 0.10) & (F.abs(b["amp"]) >= 0.10) & (high - low >= 40)
    return F.when(apart, 1 - valley / F.greatest(F.abs(a["amp"]), F.abs(b["amp"])) >= 0.30).otherwise(False)


def lead_shapes(components: DataFrame) -> DataFrame:
    """(rec, lead, one boolean for each shape, t_at, width, net, r, s): the shapes of a lead, where its dominant T stands, the width and the sum of QRS
    and its highest and deepest amplitude."""
    rows = components.groupBy("rec", "lead").agg(_parts("T").alias("ts"), _parts("QRS").alias("qs"))  # components of one lead
    top = F.array_sort(F.transform("ts", lambda g: F.struct((-F.abs(g["amp"])).alias("size"), g["center"].alias("center"), g["amp"].alias("amp"), g["sigma"].alias("sigma"))))
    rows = rows.withColumn("top", top).withColumn("n", F.size("ts"))
    t = [F.get("top", F.lit(k)) for k in range(3)]
    size = [-x["size"] for x in t]
    pair = lambda i, j: F.when(F.col("n") > max(i, j), _notch(t[i], t[j])).otherwise(False)
    first, last = F.get("ts", F.lit(0)), F.try_element_at("ts", F.lit(-1))
    two = F.col("n") >= 2
    of = lambda test: F.filter("qs", test)
    high, low = of(lambda g: g["amp"] > 0.1), of(lambda g: g["amp"] < -0.05)
    ups = F.transform(of(lambda g: g["amp"] > 0), lambda g: g["center"])
    gaps = F.zip_with(F.slice(ups, F.lit(2), F.size(ups)), ups, lambda b, a: b - a)
    shapes = {
        "t_notched": pair(0, 1) | pair(0, 2) | pair(1, 2),
        "t_split": two & (F.least(size[0], size[1]) >= 0.12) & (F.abs(t[0]["center"] - t[1]["center"]) >= 50),
        "t_plateau": two & (F.greatest(size[0], size[1]) >= 0.12) & (F.abs(size[0] - size[1]) < 0.03) & (t[0]["sigma"] >= 50) & (t[1]["sigma"] >= 50),
        "t_u_on_t": two & (last["center"] - first["center"] > 100) & (F.abs(last["amp"]) / F.greatest(F.lit(1e-9), F.abs(first["amp"])) < 0.4),
        "rsr_pattern": (F.size(high) >= 2) & (F.size(low) >= 1) & (F.get(high, F.lit(0))["center"] < F.get(low, F.lit(0))["center"]) & (F.get(low, F.lit(0))["center"] < F.try_element_at(high, F.lit(-1))["center"]),
        "splintered": F.size(of(lambda g: (F.abs(g["amp"]) > 0.05) & (F.abs(g["amp"]) < 0.2))) >= 3,
        "prominent_s": F.exists("qs", lambda g: g["amp"] < -0.3),
        "m_shape": F.exists(gaps, lambda d: (d >= 20) & (d <= 60)),
        "slurred_s": F.exists("qs", lambda g: (g["amp"] < -0.2) & (2 * g["sigma"] >= 40)),
    }
    edge = lambda f, k: f(F.transform("qs", lambda g: g["center"] + k * 2 * g["sigma"]))
    amps = F.transform("qs", lambda g: g["amp"])
    return rows.select(
        "rec", "lead", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in shapes.items()], t[0]["center"].alias("t_at"),
        (edge(F.array_max, 1) - edge(F.array_min, -1)).alias("width"), F.when(F.size("qs") > 0, F.aggregate(amps, F.lit(0.0), lambda s, a: s + a)).alias("net"), F.array_max(amps).alias("r"), F.array_min(amps).alias("s"),
    )


def recording_shapes(leads: DataFrame) -> DataFrame:
    """(rec, one boolean for each finding) from what `lead_shapes` gives: shapes that enough leads have; dispersion of the T peaks of six leads
    (over 50 ms); Sokolow voltage over 3.5 mV; axis left of -30 or right of 90 degrees; M shape in V1 or a slurred S in I or V6 with a QRS of
    110 ms in V1, I or V6, and a broad QRS of 120 ms without either."""
    place = F.array_position(F.lit(LEADS), F.col("lead"))
    hits = [F.collect_set(F.when(F.col(n) & F.col("lead").isin(list(own)), place)).alias(n) for n, (_, own, _) in SHAPES.items()]  # twelve numbers at most
    of = lambda lead, c: F.max(F.when(F.col("lead") == lead, F.col(c)))
    found = leads.groupBy("rec").agg(
        *hits, F.count("t_at").alias("t_n"), F.stddev_pop("t_at").alias("t_sd"), of("I", "net").alias("one"), of("aVF", "net").alias("foot"), of("V1", "s").alias("s1"), of("V5", "r").alias("r5"), of("V6", "r").alias("r6"),
        F.coalesce(F.max(F.when(F.col("lead").isin("V1", "I", "V6"), F.col("width"))), F.lit(0.0)).alias("wide"),
    )
    flags = {n: quorum(F.col(n), least, near) for n, (least, _, near) in SHAPES.items()}
    m, slurred = flags.pop("m_shape") & (F.col("wide") >= 110), flags.pop("slurred_s") & (F.col("wide") >= 110)
    axis = F.when((F.col("one") != 0) | (F.col("foot") != 0), F.degrees(F.atan2("foot", "one")))
    up = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    sokolow = F.greatest(-F.coalesce(F.col("s1"), F.lit(0.0)), F.lit(0.0)) + F.greatest(up("r5"), up("r6"))
    flags |= {
        "t_dispersion": (F.col("t_n") >= 6) & (F.round("t_sd", 6) > 50), "high_voltage": F.round(sokolow, 6) > 3.5, "left_axis": axis < -30, "right_axis": (F.col("foot") >= 0) & (F.col("one") < -RIGHT_ANGLE * F.col("foot")),
        "m_shaped_v1": m, "wide_slurred_s": slurred, "broad_delay": (F.col("wide") >= 120) & ~m & ~slurred,
    }
    return found.select("rec", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])


def pseudo_normal(components: DataFrame, before: DataFrame) -> DataFrame:
    """(rec, leads) of recordings in which T was mostly negative before, is mostly positive now and at least 0.15 mV higher, in two of V1, V2, V3."""

    def sides(df: DataFrame, name: str) -> DataFrame:
        amp = F.col("amp")
        sums = [F.sum(F.when(amp > 0, amp).otherwise(0.0)), F.sum(F.when(amp < 0, -amp).otherwise(0.0)), F.max(F.abs(amp))]
        return df.where("wave = 'T' and lead in ('V1', 'V2', 'V3')").groupBy("rec", "lead").agg(*[F.round(c, 9).alias(f"{name}_{k}") for c, k in zip(sums, ("up", "down", "peak"), strict=True)])

    both = sides(components, "now").join(sides(before, "was"), ["rec", "lead"]).where("was_down > was_up and now_up > now_down and round(now_peak - was_peak, 9) >= 0.15")
    return both.groupBy("rec").agg(F.count("*").alias("leads")).where("leads >= 2")
