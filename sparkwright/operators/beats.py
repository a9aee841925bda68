"""Rules on the series of beats of a recording: windows over rows of components and intervals, no row leaves the JVM.

Components are (rec, lead, beat, wave, amp, center, sigma), beats numbered from 0 in order of time; intervals are (rec, i, rr) in ms,
i from 0. A recording without what a rule needs does not meet it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the mean interval for long, short, early and paused ones; changes of P that count; leads in order of trust.
LONG, SHORT, PAUSED, P_CHANGE, ALTERNATION = 0.90, 0.85, 2.0, 0.10, 10.0
P_LEADS = ("II", "V1", "I")
AXIS_STEP, AXIS_RANGE = 20, 90


def _measured(intervals: DataFrame) -> DataFrame:
    own = Window.partitionBy("rec")
    return intervals.withColumn("mean", F.avg("rr").over(own)).withColumn("n", F.count("*").over(own))


def p_series(components: DataFrame) -> DataFrame:
    """(rec, lead, beat, beats, has_p, has_qrs, size): of each beat of a lead whether it has P and QRS, the sum of P's sizes, and the
    number of the lead's beats."""
    p = F.col("wave") == "P"
    rows = components.where("beat >= 0").groupBy("rec", "lead", "beat").agg(
        F.max(p).alias("has_p"), F.max(F.col("wave") == "QRS").alias("has_qrs"), F.coalesce(F.sum(F.when(p, F.abs("amp"))), F.lit(0.0)).alias("size")
    )
    return rows.withColumn("beats", F.max("beat").over(Window.partitionBy("rec", "lead")) + 1)


def atrial_bigeminy(intervals: DataFrame, series: DataFrame) -> DataFrame:
    """(rec, pairs, share, present): pairs of an even and the next interval of which the first is long and the second short, over half the
    number of intervals; six intervals and six beats in lead II at least, present from one half on."""
    order = Window.partitionBy("rec").orderBy("i")
    pairs = _measured(intervals).withColumn("next", F.lead("rr").over(order)).where("i % 2 = 0 and next is not null")
    hit = (F.col("rr") > LONG * F.col("mean")) & (F.col("next") < SHORT * F.col("mean"))
    found = pairs.groupBy("rec").agg(F.count_if(hit).alias("pairs"), F.max("n").alias("n")).where("n >= 6")
    enough = series.where("lead = 'II' and beats >= 6").select("rec").distinct()
    share = F.col("pairs") / (F.col("n") / 2)
    return found.join(enough, "rec").select("rec", "pairs", share.alias("share"), (share >= 0.5).alias("present"))


def dropped_beats(series: DataFrame) -> DataFrame:
    """(rec, dropped) of recordings with beats in II or V1 that have a P wave and no QRS."""
    return series.where("lead in ('II', 'V1') and has_p and not has_qrs").groupBy("rec").agg(F.count("*").alias("dropped"))


def premature_atrial(intervals: DataFrame, series: DataFrame) -> DataFrame:
    """(rec, early, share) of recordings with early beats: a short interval (not the first) at whose number lead II has a beat whose P
    differs by a tenth from that of the beat before; the last beat is left out. Five intervals and beats at least."""
    order = Window.partitionBy("rec").orderBy("beat")
    two = series.where("lead = 'II' and beats >= 5").withColumn("before", F.lag(F.struct("beat", "has_p", "size")).over(order))
    two = two.where("has_p and before.has_p and before.beat = beat - 1 and beat < beats - 1")
    two = two.where(F.abs(F.col("size") - F.col("before.size")) / F.greatest(F.col("before.size"), F.lit(0.01)) > P_CHANGE)
    short = _measured(intervals).where((F.col("n") >= 5) & (F.col("i") >= 1) & (F.col("rr") < SHORT * F.col("mean"))).select("rec", F.col("i").alias("beat"))
    found = two.join(short, ["rec", "beat"]).groupBy("rec").agg(F.count("*").alias("early"), F.max("beats").alias("beats"))
    return found.select("rec", "early", (100 * F.col("early") / F.col("beats")).alias("share"))


def sinus_arrest(intervals: DataFrame) -> DataFrame:
    """(rec, pauses, longest) of recordings of three intervals or more with one over twice the mean."""
    return _measured(intervals).where((F.col("n") >= 3) & (F.col("rr") > PAUSED * F.col("mean"))).groupBy("rec").agg(F.count("*").alias("pauses"), F.max("rr").alias("longest"))


def p_alternans(series: DataFrame, most: int = 20, least: int = 6) -> DataFrame:
    """(rec, lead, percent) of the first of II, V1, I in which P's size alternates: of the beats with P among the first `most`, the means of
    every other one differ by more than a tenth of the larger; `least` such beats with three on either side."""
    place = F.row_number().over(Window.partitionBy("rec", "lead").orderBy("beat"))
    rows = series.where(F.col("lead").isin(*P_LEADS) & (F.col("beats") >= least) & (F.col("beat") < most) & F.col("has_p")).withColumn("at", place)
    half = lambda k: F.avg(F.when(F.col("at") % 2 == k, F.col("size")))
    sides = rows.groupBy("rec", "lead").agg(half(1).alias("a"), half(0).alias("b"), F.count("*").alias("n")).where(f"n >= {least}")
    percent = F.abs(F.col("a") - F.col("b")) / F.greatest("a", "b") * 100
    hit = sides.withColumn("percent", F.round(percent, 6)).where(F.col("percent") > ALTERNATION)
    first = F.min_by(F.struct("lead", "percent"), F.array_position(F.lit(list(P_LEADS)), F.col("lead")))
    return hit.groupBy("rec").agg(first.alias("f")).select("rec", "f.lead", "f.percent")


def wandering_pacemaker(components: DataFrame, series: DataFrame, most: int = 15, least: int = 8) -> DataFrame:
    """(rec, width, changes) of recordings whose P axis wanders: among the first `most` beats with P in I and in aVF (`least` of them, and of
    lead II's beats) angles span over 90 degrees and change by over 20 three times."""
    sums = components.where("wave = 'P' and beat >= 0").groupBy("rec", "beat").agg(F.sum(F.when(F.col("lead") == "I", F.col("amp"))).alias("one"), F.sum(F.when(F.col("lead") == "aVF", F.col("amp"))).alias("foot"))
    enough = series.where(f"lead = 'II' and beats >= {least}").select("rec").distinct()
    order = Window.partitionBy("rec").orderBy("beat")
    axes = sums.where("one is not null and foot is not null and (one <> 0 or foot <> 0)").where(F.col("beat") < most).join(enough, "rec")
    axes = axes.withColumn("axis", F.round(F.degrees(F.atan2("foot", "one")), 6)).withColumn("step", F.abs(F.col("axis") - F.lag("axis").over(order)))
    found = axes.groupBy("rec").agg((F.max("axis") - F.min("axis")).alias("width"), F.count_if(F.col("step") > AXIS_STEP).alias("changes"), F.count("*").alias("n"))
    return found.where(f"n >= {least} and width > {AXIS_RANGE} and changes >= 3").select("rec", F.round("width", 6).alias("width"), "changes")


def t_axis_wandering(components: DataFrame, most: int = 20, least: int = 5) -> DataFrame:
    """(rec, spread) of recordings whose T axis, over the first `most` beats with T in I and in aVF (`least` or more), deviates by over 45 degrees."""
    one, foot = (F.sum(F.when(F.col("lead") == x, F.col("amp"))) for x in ("I", "aVF"))
    sums = components.where(F.col("beat").between(0, most - 1) & (F.col("wave") == "T")).groupBy("rec", "beat").agg(one.alias("one"), foot.alias("foot"))
    axes = sums.where("one is not null and foot is not null").withColumn("axis", F.degrees(F.atan2("foot", "one")))
    found = axes.groupBy("rec").agg(F.round(F.stddev_pop("axis"), 6).alias("spread"), F.count("*").alias("n"))
    return found.where(f"n >= {least} and spread > 45").select("rec", "spread")


def p_notching(components: DataFrame, low: float = 40.0, high: float = 120.0, least: int = 3) -> DataFrame:
    """(rec, notches) of recordings with a lead of II, V1, I in which in `least` beats two neighbouring P components of one sign stand `low` to `high`
    ms apart: the number of such beats of such leads."""
    order = Window.partitionBy("rec", "lead", "beat").orderBy("center", "amp")
    p = components.where((F.col("wave") == "P") & (F.col("beat") >= 0) & F.col("lead").isin(*P_LEADS))
    p = p.withColumn("gap", F.col("center") - F.lag("center").over(order)).withColumn("same", F.col("amp") * F.lag("amp").over(order) > 0)
    beats = p.where(F.col("gap").between(low, high) & F.col("same")).select("rec", "lead", "beat").distinct()
    return beats.groupBy("rec", "lead").agg(F.count("*").alias("n")).where(f"n >= {least}").groupBy("rec").agg(F.sum("n").alias("notches"))


def next_qrs(events: DataFrame) -> DataFrame:
    """(rec, at, qrs_at) of each P event with the next QRS event of its recording, from (rec, wave, at): an as-of join as one window over both
    kinds, without pairs; null if none follows. A QRS at the same time counts as following."""
    order = Window.partitionBy("rec").orderBy("at", F.when(F.col("wave") == "P", 0).otherwise(1)).rowsBetween(0, Window.unboundedFollowing)
    ahead = F.first(F.when(F.col("wave") == "QRS", F.col("at")), ignorenulls=True).over(order)
    return events.where("wave in ('P', 'QRS') and at is not null").withColumn("qrs_at", ahead).where("wave = 'P'").select("rec", "at", "qrs_at")


def conduction(events: DataFrame, most: float = 400.0) -> DataFrame:
    """(rec, p_waves, conducted, dropped, mean_pr): P events whose next QRS comes within `most` ms, and those without."""
    pr = F.col("qrs_at") - F.col("at")
    ok = F.coalesce(pr <= most, F.lit(False))
    return next_qrs(events).groupBy("rec").agg(F.count("*").alias("p_waves"), F.count_if(ok).alias("conducted"), F.count_if(~ok).alias("dropped"), F.avg(F.when(ok, pr)).alias("mean_pr"))
