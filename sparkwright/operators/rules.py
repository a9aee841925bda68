"""Rules over wave components and per-recording measures: one generic evaluator and the threshold tables it runs.

Components are long rows (rec, lead, beat, wave, amp, center, sigma). A rule is a predicate on a component and a quorum of
leads; all rules are counted in one aggregate by recording, so their number does not add exchanges. Research use only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.signals import LEADS
from sparkwright.operators.ordering import interpolated


@dataclass(frozen=True)
class Rule:
    name: str
    wave: str
    test: str
    least: int = 1
    leads: tuple[str, ...] = tuple(LEADS)
    contiguous: bool = False


LIMB, CHEST, INFERIOR = tuple(LEADS[:6]), tuple(LEADS[6:]), ("II", "III", "aVF")
#: Thresholds of the component rules (mV and ms).
RULES = [
    Rule("t_inverted", "T", "amp <= -0.20", 2, tuple(x for x in LEADS if x != "aVR"), True),
    Rule("t_hyperacute", "T", "amp > 1.2 and sigma < 50", 2, CHEST),
    Rule("t_peaked", "T", "amp > 0.5 and sigma < 40"),
    Rule("t_abrupt", "T", "sigma < 20"),
    Rule("t_plateau", "T", "amp >= 0.12 and sigma >= 50"),
    Rule("pr_depression", "P", "amp < -0.04", 2),
    Rule("p_tall", "P", "amp >= 0.20"),
    Rule("p_low", "P", "abs(amp) < 0.05", 8),
    Rule("p_retrograde", "P", "amp < -0.03", 2, INFERIOR),
    Rule("qrs_low_limb", "QRS", "abs(amp) < 0.5", 3, LIMB),
    Rule("qrs_low_chest", "QRS", "abs(amp) < 1.0", 3, CHEST),
    Rule("deep_s", "QRS", "amp < -0.3", 2),
    Rule("tall_r", "QRS", "lead = 'aVR' and amp > 0.5 or lead in ('V1', 'V2') and amp > 0.7 or lead in ('V5', 'V6') and amp > 2.5"),
    Rule("micro_qrs", "QRS", "abs(amp) < 0.1", 6),
    Rule("slurred", "QRS", "sigma > 25", 2),
    Rule("paced", "QRS", "sigma < 5 and center < -50"),
]
#: Territories and their reciprocal leads.
TERRITORIES = {"inferior": (("II", "III", "aVF"), ("I", "aVL")), "lateral": (("I", "aVL", "V5", "V6"), ("II", "III", "aVF")), "anterior": (("V1", "V2", "V3", "V4"), ("II", "III", "aVF"))}


def evaluate(components: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(rec, one boolean column for each rule): whether enough leads (in a row, where the rule asks that) pass."""
    rules = RULES if rules is None else rules
    hits = [
        F.collect_set(F.when((F.col("wave") == r.wave) & F.col("lead").isin(list(r.leads)) & F.expr(r.test), F.array_position(F.lit(LEADS), F.col("lead")))).alias(r.name)
        for r in rules
    ]
    found = components.groupBy("rec").agg(*hits)  # at most twelve numbers for each rule and recording
    return found.select("rec", *[quorum(F.col(r.name), r.least, r.contiguous).alias(r.name) for r in rules])


def quorum(places: Column, least: int, contiguous: bool) -> Column:
    if not contiguous:
        return F.size(places) >= least
    runs = F.transform(places, lambda p: F.forall(F.sequence(F.lit(0), F.lit(least - 1)), lambda k: F.array_contains(places, p + k)))
    return F.exists(runs, lambda x: x)


def axis(avf: Column, lead1: Column) -> tuple[Column, Column]:
    """Frontal axis in degrees and its band."""
    angle = F.degrees(F.atan2(avf, lead1))
    return angle, F.when(angle < -90, "extreme").when(angle < -30, "left").when(angle > 90, "right").otherwise("normal")


def hypertrophy(s_v1: Column, r_v5: Column, r_v6: Column, r_avl: Column, s_v3: Column, female: Column) -> Column:
    """Names of the voltage criteria that hold."""
    tests = [(s_v1 + F.greatest(r_v5, r_v6) >= 3.5, "sokolow"), (r_avl + s_v3 >= F.when(female, 2.0).otherwise(2.8), "cornell"), (r_avl >= 1.1, "avl")]
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))


def st_threshold(lead: Column, age: Column, male: Column) -> Column:
    """Elevation threshold in mV: V2 and V3 by sex and age, 0.1 elsewhere."""
    return F.when(lead.isin("V2", "V3"), F.when(~male, 0.15).when(age < 40, 0.25).otherwise(0.2)).otherwise(0.1)


def st_grade(deviation: Column) -> Column:
    """Grade of a threshold-normalised deviation."""
    size = F.abs(deviation)
    return F.when(size < 1, "none").when(size < 2, "mild").when(size < 3, "moderate").otherwise("severe")


def torsade_points(sls: Column, modulation: Column, depth: Column, reversals: Column, ectopy: Column, bimodal: Column) -> tuple[Column, Column]:
    one = lambda c: F.when(c, 1).otherwise(0)
    points = 2 * one(sls) + 3 * one(modulation) + one(depth > 0.5) + one(reversals >= 4) + one(ectopy > 0.2) + one(bimodal > 1.5)
    return points, F.when(points >= 6, "high").when(points >= 4, "moderate").when(points >= 2, "low").otherwise("negligible")


def exclusive_conflicts(present: Column, groups: list[list[str]]) -> Column:
    """The groups of labels that exclude each other of which a set holds more than one."""
    both = [F.when(F.size(F.array_intersect(present, F.array(*[F.lit(x) for x in g]))) > 1, F.lit("/".join(g))) for g in groups]
    return F.array_compact(F.array(*both))


def composite(parts: list[tuple[Column, float]]) -> Column:
    """Weighted sum of parts held to 0 to 1."""
    return sum((F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) * w for c, w in parts[1:]), F.least(F.lit(1.0), F.greatest(F.lit(0.0), parts[0][0])) * parts[0][1])


def wave_similarity(a1: Column, a2: Column, angle: Column) -> Column:
    return F.exp(-F.abs(F.log(a1 / a2))) * F.cos(F.radians(angle))


def territories(deviations: DataFrame) -> DataFrame:
    """(rec, territory, n, elevated, reciprocal, mean, extreme) of (rec, lead, dev): primary and reciprocal leads by a small
    table, the signed value of largest size kept."""
    spark = deviations.sparkSession
    rows = [(t, role, lead) for t, pair in TERRITORIES.items() for role, leads in zip(("primary", "reciprocal"), pair, strict=True) for lead in leads]
    parts = F.broadcast(spark.createDataFrame(rows, "territory string, role string, lead string"))  # a constant table
    both = deviations.join(parts, "lead")
    own, other = F.col("role") == "primary", F.col("role") == "reciprocal"
    return both.groupBy("rec", "territory").agg(
        F.count_if(own).alias("n"), F.count_if(own & (F.col("dev") >= 1)).alias("elevated"), F.count_if(other & (F.col("dev") <= -1)).alias("reciprocal"),
        F.avg(F.when(own, F.col("dev"))).alias("mean"), F.max_by(F.when(own, F.col("dev")), F.when(own, F.struct(F.abs("dev"), F.col("dev")))).alias("extreme"),
    )


def deviation_summary(deviations: DataFrame) -> DataFrame:
    """max, min, sums and counts by sign, and polarity balance in [-1, 1] of each recording."""
    up, down = F.col("dev") > 0, F.col("dev") < 0
    out = deviations.groupBy("rec").agg(
        F.max("dev").alias("max"), F.min("dev").alias("min"), F.coalesce(F.sum(F.when(up, F.col("dev"))), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(F.when(down, -F.col("dev"))), F.lit(0.0)).alias("down"), F.count_if(up).alias("n_up"), F.count_if(down).alias("n_down"),
    )
    return out.withColumn("balance", F.coalesce(F.try_divide(F.col("up") - F.col("down"), F.col("up") + F.col("down")), F.lit(0.0)))


def clinical_intervals(components: DataFrame) -> DataFrame:
    """Durations from two sigmas around the components of each wave, not below 0, and PR and QT across waves."""
    start, end = F.col("center") - 2 * F.col("sigma"), F.col("center") + 2 * F.col("sigma")
    of = lambda w, c, f: f(F.when(F.col("wave") == w, c))
    b = components.groupBy("rec").agg(*[e.alias(f"{w.lower()}{k}") for w in ("P", "QRS", "T") for e, k in ((of(w, start, F.min), 0), (of(w, end, F.max), 1))])
    span = lambda a, z: F.round(F.greatest(F.lit(0.0), F.col(z) - F.col(a)), 2)
    return b.select("rec", span("p0", "p1").alias("p_ms"), span("qrs0", "qrs1").alias("qrs_ms"), span("p0", "qrs0").alias("pr_ms"), span("qrs0", "t1").alias("qt_ms"))


def trimmed_fusion(values: DataFrame, trim: float = 0.25, gate: float = 60.0) -> DataFrame:
    """One value for each recording from (rec, lead, value): per-lead medians, trimmed mean, then the mean of the medians
    within the gate of it."""
    med = values.groupBy("rec", "lead").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    own = Window.partitionBy("rec")
    ranked = med.withColumn("r", F.row_number().over(own.orderBy("m", "lead"))).withColumn("n", F.count("*").over(own))
    cut = F.floor(F.col("n") * trim)
    first = ranked.withColumn("t", F.avg(F.when((F.col("r") > cut) & (F.col("r") <= F.col("n") - cut), F.col("m"))).over(own))
    return first.groupBy("rec").agg(F.avg(F.when(F.abs(F.col("m") - F.col("t")) <= gate, F.col("m"))).alias("fused"), F.count("*").alias("leads"))


def bazett(qt_ms: Column, rr_ms: Column) -> Column:
    return qt_ms / F.sqrt(rr_ms / 1000)


def consensus_center(rows: DataFrame, q=F) -> DataFrame:
    """(rec, center) from (rec, lead, i, center, snr): leads under -3 dB go, weights 10^(snr / 20) are held to eight times
    the smallest, values beyond 1.5 quartile ranges go, and the weighted median is null if what is left spreads over 80 ms."""
    own = Window.partitionBy("rec")
    kept = rows.where("snr >= -3").withColumn("w", F.pow(F.lit(10.0), 0.05 * F.col("snr")))
    kept = kept.withColumn("w", F.least(F.col("w"), 8 * F.min("w").over(own)))
    fenced = kept.withColumn("q1", F.percentile("center", F.lit(0.25)).over(own)).withColumn("q3", F.percentile("center", F.lit(0.75)).over(own))
    pad = 1.5 * (F.col("q3") - F.col("q1"))
    left = fenced.where(F.col("center").between(F.col("q1") - pad, F.col("q3") + pad))
    run = F.sum("w").over(own.orderBy("center", "i").rowsBetween(Window.unboundedPreceding, 0))
    placed = left.withColumn("run", run).withColumn("half", F.sum("w").over(own) / 2)
    out = placed.groupBy("rec").agg(F.min(F.when(F.col("run") >= F.col("half"), F.col("center"))).alias("m"), (F.max("center") - F.min("center")).alias("spread"))
    return out.select("rec", F.when(F.col("spread") <= 80, F.col("m")).alias("center"))


def best_candidate(rows: DataFrame) -> DataFrame:
    """The candidate (rec, i, offset, confidence, duration, method) with the largest score, the first of equals."""
    score = (
        F.when(F.abs("offset") <= 20, 2).when(F.abs("offset") <= 60, 1).otherwise(-1) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
        + F.when(F.col("duration").between(40, 160), 1.0).when(F.col("duration").between(20, 240), 0.5).otherwise(0.0) + F.when(F.col("method") == "energy", 0.3).otherwise(0.1)
    )
    return rows.withColumn("score", score).groupBy("rec").agg(F.min_by("i", F.struct(-F.col("score"), F.col("i"))).alias("i"), F.max("score").alias("score"))


def regression_alternation(rows: DataFrame, sizes: tuple[int, ...] = (12, 10, 8), ratio: float = 0.9, delta: float = 12.0, spread: float = 0.02) -> DataFrame:
    """(key, ratio, delta, size, present) from (key, i, rr), i counting on from 0: alternation of a series of at least eight values.

    The series is divided by its median (which must be above 0) and loses its running mean of five (places outside count as 0) and
    its mean. In each window a +-1 regression gives the ratio of its slope to the deviation of what it leaves, and delta is the
    difference of the means of even and odd places in per cent of the window's median, of the series before it lost its mean.
    The window with the largest ratio counts (of equals the one with the largest delta); series of little spread have none.
    """
    own, order = Window.partitionBy("key"), Window.partitionBy("key").orderBy("i")
    x = rows.withColumn("n", F.count("*").over(own)).where(F.col("n") >= 8).withColumn("med", F.percentile("rr", F.lit(0.5)).over(own)).where("med > 0")
    x = x.withColumn("norm", F.col("rr") / F.col("med")).withColumn("run", F.sum("norm").over(order.rowsBetween(-2, 2)) / 5)
    x = x.where(F.lit(True)).withColumn("sd", F.stddev_pop("norm").over(own)).where(F.col("sd") >= spread).withColumn("rest", F.col("norm") - F.col("run"))
    x = x.withColumn("hp", F.col("rest") - F.avg("rest").over(own))
    found = None
    for size in sizes:
        frame = order.rowsBetween(-(size - 1), 0)
        even = lambda c, k, w=frame: F.avg(F.when(F.col("i") % 2 == k, F.col(c))).over(w)
        slope = F.abs(even("hp", 0) - even("hp", 1)) / 2
        left = F.sqrt(F.greatest(F.lit(0.0), F.var_pop("hp").over(frame) - slope * slope))
        part = 100 * F.abs(even("norm", 0) - even("norm", 1)) / (F.abs(F.percentile("norm", F.lit(0.5)).over(frame)) + 1e-9)
        here = x.withColumn("held", F.count("*").over(frame)).withColumn("r", slope / (left + 1e-9)).withColumn("d", part).where(F.col("held") == size)
        here = here.select("key", F.round("r", 6).alias("r"), F.round("d", 6).alias("d"), F.lit(size).alias("size"))
        found = here if found is None else found.unionByName(here)
    best = found.groupBy("key").agg(F.max(F.struct("r", "d", "size")).alias("b"))
    return best.select("key", F.col("b.r").alias("ratio"), F.col("b.d").alias("delta"), F.col("b.size").alias("size"), ((F.col("b.r") >= ratio) & (F.col("b.d") >= delta)).alias("present"))


def atrial_energy(components: DataFrame) -> DataFrame:
    """(rec, kept, area, top, state) of the P components (rec, wave, amp, sigma) that are no artefacts: at most a quarter of the
    largest QRS amplitude (1 without any), not both wider than 25 ms and below a twentieth of it, 3 ms wide at least, and above
    0.008 and 1.2 times the tenth percentile of the P amplitudes. AF_LIKELY unless their area exceeds 0.5 and a peak passes."""
    size, p, whole = F.abs("amp"), F.col("wave") == "P", Window.partitionBy("rec")
    rows = interpolated(components.select("rec", "wave", "amp", "sigma", F.when(p, size).alias("size")), "size", 0.1, ["rec"], "floor")
    rows = rows.withColumn("qrs", F.coalesce(F.max(F.when(F.col("wave") == "QRS", size)).over(whole), F.lit(1.0)))
    rows = rows.withColumn("least", F.greatest(F.lit(0.008), 1.2 * F.coalesce("floor", F.lit(0.0))))
    good = (F.col("amp") <= 0.25 * F.col("qrs")) & ~((F.col("sigma") > 25) & (F.col("amp") < 0.05 * F.col("qrs"))) & (F.col("sigma") >= 3) & (F.col("size") >= F.col("least"))
    kept = lambda c: F.when(p & good & F.col("rec").isNotNull(), c)
    out = rows.groupBy("rec").agg(
        F.max("least").alias("least"), F.count(kept(F.lit(1))).alias("kept"),
        F.coalesce(F.sum(kept(F.col("size") * F.col("sigma") * 2.5066)), F.lit(0.0)).alias("area"), F.coalesce(F.max(kept(F.col("size"))), F.lit(0.0)).alias("top"),
    )
    state = F.when((F.col("area") > 0.5) & (F.col("top") > F.col("least")), "P_ACTIVITY_PRESENT").otherwise("AF_LIKELY")
    return out.select("rec", "kept", "area", "top", state.alias("state"))


#: Leads of the patterns, thresholds in mV.
ANTERIOR, INFERIOR_LEADS, LATERAL, POSTERIOR, STRAIN = ("V1", "V2", "V3", "V4"), ("II", "III", "aVF"), ("I", "aVL", "V5", "V6"), ("V1", "V2", "V3"), ("V5", "V6", "I", "aVL")
DEPRESSION, HIGH_TAKE_OFF = -0.05, 0.20


def st_offset(qt: Column) -> Column:
    """How long after the J point ST is read, by the length of QT."""
    return F.when(qt <= 140, 60).when(qt <= 180, 80).when(qt <= 220, 100).otherwise(120)


def st_patterns(leads: DataFrame, cases: DataFrame) -> DataFrame:
    """(rec, one boolean for each pattern) from (rec, lead, a60, a80, a100, a120, shape) and (rec, qt, age, male, depressed).

    Two leads of a territory at their elevation threshold make an infarct pattern (0.2 mV at least in V1 and V2 where
    depression is global), two of V1-V3 in depression a posterior one, six leads diffuse depression, eight above half of their
    threshold pericarditis, two of V5, V6, I, aVL in depression and downsloping or scooped strain. aVR is never depressed.
    """
    both = leads.join(cases, "rec").withColumn("off", st_offset(F.col("qt")))
    amp = F.when(F.col("off") == 60, F.col("a60")).when(F.col("off") == 80, F.col("a80")).when(F.col("off") == 100, F.col("a100")).otherwise(F.col("a120"))
    base = st_threshold(F.col("lead"), F.col("age"), F.col("male"))
    strict = F.when(F.col("depressed") & F.col("lead").isin("V1", "V2"), F.greatest(base, F.lit(HIGH_TAKE_OFF))).otherwise(base)
    both = both.withColumn("up", amp >= strict).withColumn("half", amp > base / 2).withColumn("down", (amp <= DEPRESSION) & (F.col("lead") != "aVR"))
    n = lambda flag, names=None: F.count_if(F.col(flag) & (F.col("lead").isin(list(names)) if names else F.lit(True)))
    strain = F.count_if(F.col("down") & F.col("lead").isin(list(STRAIN)) & F.col("shape").isin("downsloping", "scooped"))
    return both.groupBy("rec").agg(
        (n("up", ANTERIOR) >= 2).alias("anterior"), (n("up", INFERIOR_LEADS) >= 2).alias("inferior"), (n("up", LATERAL) >= 2).alias("lateral"),
        (n("down", POSTERIOR) >= 2).alias("posterior"), (n("down") >= 6).alias("diffuse_depression"), (n("half") >= 8).alias("pericarditis"), (strain >= 2).alias("strain"),
    )


def reciprocal_pairs(leads: DataFrame) -> DataFrame:
    """(rec, elevated, depressed) of the territory pairs in which one has an elevated and the other a depressed lead, from
    (rec, lead, up, down): anterior and lateral against inferior, either way."""
    n = lambda flag, names: F.count_if(F.col(flag) & F.col("lead").isin(list(names)))
    names = {"anterior": ANTERIOR, "lateral": LATERAL, "inferior": INFERIOR_LEADS}
    wide = leads.groupBy("rec").agg(*[n(flag, x).alias(f"{k}_{flag}") for k, x in names.items() for flag in ("up", "down")])
    pair = lambda a, b: F.when((F.col(f"{a}_up") >= 1) & (F.col(f"{b}_down") >= 1), F.struct(F.lit(a).alias("elevated"), F.lit(b).alias("depressed")))
    found = [pair("anterior", "inferior"), pair("inferior", "anterior"), pair("lateral", "inferior"), pair("inferior", "lateral")]
    return wide.select("rec", F.inline(F.array_compact(F.array(*found))))


def territory_shapes(leads: DataFrame) -> DataFrame:
    """(rec, territory, shape, slope): the most frequent shape of a territory's leads, the first in lead order of equals, and the
    mean slope in uV a ms, from (rec, lead, shape, slope in mV a ms)."""
    names = {"anterior": ANTERIOR, "inferior": INFERIOR_LEADS, "lateral": LATERAL}
    rows = [(t, lead, i) for t, own in names.items() for i, lead in enumerate(own)]
    parts = F.broadcast(leads.sparkSession.createDataFrame(rows, "territory string, lead string, place int"))  # a constant table
    both = leads.join(parts, "lead")
    counts = both.groupBy("rec", "territory", "shape").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sum("slope").alias("total"))
    return counts.groupBy("rec", "territory").agg(F.min_by("shape", F.struct(-F.col("n"), F.col("first"))).alias("shape"), (1000 * F.sum("total") / F.sum("n")).alias("slope"))


#: Rules on what a lead measures (mV and ms), with the leads that must pass.
LEAD_RULES = [
    Rule("t_flattened", "", "abs(t_amp) < greatest(0.08, 0.12 * qrs_size)", 3, tuple(LEADS), True),
    Rule("t_biphasic", "", "t_pos > 0 and t_neg < 0 and least(t_pos, -t_neg) >= greatest(0.15, 0.3 * abs(t_amp)) and least(t_pos, -t_neg) >= 0.3 * greatest(t_pos, -t_neg) and abs(t_pos_at - t_neg_at) >= 35"),
    Rule("t_prolonged", "", "t_end - t_start > 360 and abs(t_amp) >= 0.10", 2, tuple(LEADS), True),
    Rule("t_early_end", "", "t_end - t_start < 0.12 * rr and abs(t_amp) >= 0.10", 2, tuple(x for x in LEADS if x not in ("aVR", "V1")), True),
    Rule("t_asymmetric", "", "t_n >= 2 and greatest(1, t_widest) > 3 * greatest(1, t_narrowest)", 2, tuple(LEADS), True),
    Rule("t_discordant", "", "t_amp * qrs_amp < 0 and abs(t_amp) >= 0.20 and qrs_size >= 0.7"),
    Rule("t_fused", "", "t_end > 0.65 * rr"),
    Rule("t_hidden", "", "rr <= 800 and t_start < qrs_end + 10", 3),
    Rule("long_st", "", "coalesce(rr, 800) >= 800 and t_start - qrs_end_near > 200 and abs(t_amp) >= 0.10", 2, ("V2", "V3", "V4", "V5"), True),
    Rule("left_atrial", "", "p_end - p_start >= 110 or p_n >= 2"),
    Rule("interatrial_block", "", "p_end - p_start >= 120 and lead = 'V1' and p_pos > 0 and p_neg < -0.02"),
    Rule("p_split", "", "p_pos > 0 and p_neg > 0 and p_last_at - p_first_at between 40 and 120 or p_pos < 0 and p_last_at - p_first_at between 40 and 120"),
    Rule("flutter_waves", "", "p_n >= 2", 2),
    Rule("av_block_1", "", "qrs_start - p_start >= 230", 1, ("I", "II", "V1")),
    Rule("short_pr", "", "qrs_start - p_start < 100", 1, ("I", "II", "V1")),
    Rule("qrs_wide", "", "qrs_end - qrs_start > 120"),
    Rule("pathological_q", "", "qrs_first < 0 and -qrs_first > 0.25 * r and 4 * qrs_first_sigma > 40"),
    Rule("fragmented", "", "qrs_n >= 3 and qrs_peaks >= 3 and qrs_size >= 0.20", 2, tuple(LEADS), True),
    Rule("epsilon", "", "qrs_late_low >= 1", 1, ("V1", "V2", "V3")),
    Rule("qrs_notched", "", "qrs_high >= 2 or qrs_low >= 2", 2),
    Rule("qs_pattern", "", "r <= 0.05 and s < -0.2"),
    Rule("absent_r", "", "r <= 0.05", 2, ("V1", "V2", "V3")),
    Rule("delayed_peak", "", "r_last_at > 45", 1, ("V5", "V6")),
    Rule("s_dominant", "", "s < -0.3 and -s > r", 2),
    Rule("early_slur", "", "qrs_early_wide >= 1"),
    Rule("pr_below_120", "", "qrs_start - p_start < 120", 1, ("II",)),
    Rule("chest_r", "", "r > 0", 4, CHEST),
    Rule("r_of_v3", "", "r >= 0.3", 1, ("V3",)),
    Rule("r_of_v4", "", "r >= 0.5", 1, ("V4",)),
]
#: Rules on what several leads say together, over the names above.
JOINT_RULES = {"delta_wave": "early_slur and pr_below_120", "poor_r_progression": "chest_r and not (r_of_v3 and r_of_v4)"}


def lead_measures(components: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row for each (rec, lead) with what its P, QRS and T components measure, and the recording's mean interval `rr` from
    intervals (rec, rr). Extents reach two sigmas; a wave that is missing leaves nulls, and rules on it don't pass."""
    of = lambda w, c: F.when(F.col("wave") == w, c)
    amp, at, sigma, i = F.col("amp"), F.col("center"), F.col("sigma"), F.col("i")
    q = lambda c: of("QRS", c)
    tail = [i, amp, at, sigma]  # components that agree in these are equal
    first = last = of("QRS", F.struct(at.alias("first"), *tail))
    out = components.groupBy("rec", "lead").agg(
        F.max_by(of("T", amp), of("T", F.struct(F.abs(amp).alias("first"), *tail))).alias("t_amp"), F.max(of("T", amp)).alias("t_pos"), F.min(of("T", amp)).alias("t_neg"),
        F.max_by(of("T", at), of("T", F.struct(amp.alias("first"), *tail))).alias("t_pos_at"), F.min_by(of("T", at), of("T", F.struct(amp.alias("first"), *tail))).alias("t_neg_at"),
        F.min(of("T", at - 2 * sigma)).alias("t_start"), F.max(of("T", at + 2 * sigma)).alias("t_end"), F.max(of("T", sigma)).alias("t_widest"), F.min(of("T", sigma)).alias("t_narrowest"),
        F.count(of("P", amp)).alias("p_n"), F.max(of("P", amp)).alias("p_pos"), F.min(of("P", amp)).alias("p_neg"), F.min(of("P", at)).alias("p_first_at"), F.max(of("P", at)).alias("p_last_at"),
        F.count(of("T", amp)).alias("t_n"), F.max(q(at + sigma)).alias("qrs_end_near"), F.sort_array(F.collect_list(q(at))).alias("qrs_centers"),
        F.count_if((F.col("wave") == "QRS") & (at > 80) & (amp > 0) & (amp < 0.2)).alias("qrs_late_low"), F.count_if((F.col("wave") == "QRS") & (at < -20) & (sigma > 20)).alias("qrs_early_wide"),
        F.count_if((F.col("wave") == "QRS") & (amp > 0.1)).alias("qrs_high"), F.count_if((F.col("wave") == "QRS") & (amp < -0.1)).alias("qrs_low"), F.max(F.when(amp > 0.1, q(at))).alias("r_last_at"),
        F.min(of("P", at - 2 * sigma)).alias("p_start"), F.max(of("P", at + 2 * sigma)).alias("p_end"),
        F.count(q(amp)).alias("qrs_n"), F.count_if((F.col("wave") == "QRS") & (amp > 0)).alias("qrs_up"), F.count_if((F.col("wave") == "QRS") & (amp < 0)).alias("qrs_down"),
        F.max_by(q(amp), q(F.struct(F.abs(amp).alias("first"), *tail))).alias("qrs_amp"), F.max(q(F.abs(amp))).alias("qrs_size"), F.max(q(amp)).alias("r"), F.min(q(amp)).alias("s"), F.max_by(q(at), q(F.struct(amp.alias("first"), *tail))).alias("r_at"),
        F.min_by(amp, first).alias("qrs_first"), F.min_by(sigma, first).alias("qrs_first_sigma"), F.min(q(at)).alias("qrs_first_at"), F.max_by(amp, last).alias("qrs_last"), F.max(q(at)).alias("qrs_last_at"),
        F.min(q(at - 2 * sigma)).alias("qrs_start"), F.max(q(at + 2 * sigma)).alias("qrs_end"),
    )
    gaps = F.expr("size(filter(zip_with(slice(qrs_centers, 2, size(qrs_centers)), qrs_centers, (b, a) -> b - a), d -> d > 15))")  # components of one lead
    out = out.withColumn("qrs_peaks", F.when(F.size("qrs_centers") > 0, gaps + 1).otherwise(0)).drop("qrs_centers")
    return out.join(intervals.select("rec", "rr"), "rec", "left")


def evaluate_leads(measures: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(rec, one boolean column for each rule on the measures of leads and, with the full table, for each joint one)."""
    rules = LEAD_RULES if rules is None else rules
    place = F.array_position(F.lit(LEADS), F.col("lead"))
    hits = [F.collect_set(F.when(F.col("lead").isin(list(r.leads)) & F.expr(r.test), place)).alias(r.name) for r in rules]
    found = measures.groupBy("rec").agg(*hits)  # at most twelve numbers for each rule and recording
    out = found.select("rec", *[F.coalesce(quorum(F.col(r.name), r.least, r.contiguous), F.lit(False)).alias(r.name) for r in rules])
    return out.select("*", *[F.expr(t).alias(n) for n, t in JOINT_RULES.items()]) if rules is LEAD_RULES else out


#: Rules on a recording: bpm, cv, pnn50, shortest (interval over the mean), regular and irregular (shares of windows), p_amp
#: (largest P), qrs_ms (widest QRS), n (intervals), of lead II has_ii, p_ii_n and p_ii_low (number and lowest amplitude of P), p_beats,
#: p_amp_cv and p_dur_cv (beats with P and how much P varies over them), p_share (of beats with P), dominant (share of the largest
#: QRS cluster) and ectopy (beats outside of it), short_st (leads of V2-V4 with an ST segment under 60 ms).
RECORDING_RULES = {
    "sinus": "bpm between 60 and 100 and regular > 0.8 and p_amp > 0.05",
    "bradycardia": "bpm < 60",
    "tachycardia": "bpm > 100",
    "irregular": "n >= 12 and (cv >= 0.12 or irregular >= 0.40)",
    "supraventricular_tachycardia": "bpm > 150 and cv < 0.1 and qrs_ms > 0 and qrs_ms < 120",
    "ventricular_tachycardia": "bpm > 120 and qrs_ms > 120",
    "accelerated_idioventricular": "bpm between 60 and 120 and qrs_ms > 120 and coalesce(p_amp, 0) <= 0.05",
    "junctional": "bpm between 40 and 60 and has_ii and (p_ii_n = 0 or p_ii_low < -0.05)",
    "escape": "bpm < 40",
    "early_beat": "shortest < 0.4",
    "fibrillation": "coalesce(p_amp, 0) <= 0.05 and cv > 0.15",
    "absolute_arrhythmia": "(irregular > 0.50 or cv > 0.12 and pnn50 > 20) and coalesce(p_share, 0) < 0.4 and (coalesce(dominant, 1) < 0.70 or coalesce(ectopy, 0) < 0.15)",
    "atrial_multifocal": "n >= 3 and bpm >= 100 and p_beats >= 5 and (p_amp_cv > 0.15 or p_dur_cv > 0.15)",
    "low_variability": "n >= 60 and regular > 0.5 and rmssd < 20 and sdnn < 30",
    "pause": "longest > 2",
    "critical": "bpm > 150 and coalesce(qrs_ms, 80) > 120 or bpm < 40 or short_st >= 2",
}


def p_variation(components: DataFrame, most: int = 15) -> DataFrame:
    """(rec, p_beats, p_amp_cv, p_dur_cv) over the first `most` beats of lead II: beats with P and the coefficients of variation of
    P's summed amplitudes and of its summed widths (four sigmas), 0 where a mean is 0."""
    first = components.where("lead = 'II'").groupBy("rec", "beat").agg(
        F.count_if(F.col("wave") == "P").alias("n"), F.sum(F.when(F.col("wave") == "P", F.abs("amp"))).alias("amp"), F.sum(F.when(F.col("wave") == "P", 4 * F.col("sigma"))).alias("dur")
    )
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("rec").orderBy("beat"))).where((F.col("place") <= most) & (F.col("n") > 0))
    cv = lambda c: F.round(F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0)), 6)
    return first.groupBy("rec").agg(F.count("*").alias("p_beats"), cv("amp").alias("p_amp_cv"), cv("dur").alias("p_dur_cv"))


def evaluate_recordings(cases: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(rec, one boolean column for each rule on a recording); where absolute arrhythmia holds, low variability doesn't."""
    rules = RECORDING_RULES if rules is None else rules
    out = cases.select("rec", *[F.coalesce(F.expr(t), F.lit(False)).alias(n) for n, t in rules.items()])
    if {"low_variability", "absolute_arrhythmia"} <= set(rules):
        out = out.withColumn("low_variability", F.col("low_variability") & ~F.col("absolute_arrhythmia"))
    return out


def beat_series(components: DataFrame, wave: str) -> DataFrame:
    """(rec, lead, beat, amp): the largest amplitude of a wave's components in each beat, with its sign."""
    return components.where(F.col("wave") == wave).groupBy("rec", "lead", "beat").agg(F.max_by("amp", F.struct(F.abs("amp"), F.col("amp"))).alias("amp"))


def alternans(series: DataFrame, least: int = 8, flips: float = 0.7, spread: float = 0.15, halves: float = 0.15) -> DataFrame:
    """(rec, lead, n, flip_share, cv, half_gap, by_flips, by_halves) of series with `least` beats: T alternans by the share of sign
    changes of successive differences and the coefficient of variation, QRS alternans by the gap of even and odd means."""
    order = Window.partitionBy("rec", "lead").orderBy("beat")
    d = series.withColumn("at", F.row_number().over(order)).withColumn("d", F.col("amp") - F.lag("amp").over(order)).withColumn("d0", F.lag("d").over(order))
    flip = F.when(F.col("d0").isNotNull(), (F.col("d") * F.col("d0") < 0).cast("int"))
    half = lambda k: F.avg(F.when(F.col("at") % 2 == k, F.col("amp")))
    out = d.groupBy("rec", "lead").agg(F.count("*").alias("n"), F.avg(flip).alias("flip_share"), F.abs(F.try_divide(F.stddev_pop("amp"), F.avg("amp"))).alias("cv"), F.abs(F.try_divide(half(0) - half(1), F.avg("amp"))).alias("half_gap")).where(F.col("n") >= least)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumn("by_flips", yes((F.col("flip_share") >= flips) & (F.col("cv") > spread))).withColumn("by_halves", yes(F.col("half_gap") > halves))


#: Leads of each artery's territory, and those opposite to it.
ARTERIES = {
    "LAD": (("V1", "V2", "V3", "V4"), ("II", "III", "aVF")),
    "LCx": (("I", "aVL", "V5", "V6"), ("V1", "V2", "V3")),
    "RCA": (("II", "III", "aVF"), ("I", "aVL")),
    "Posterior": ((), ("V1", "V2", "V3")),
    "RV": (("V1",), ()),
}


def artery_fractions(leads: DataFrame) -> DataFrame:
    """(rec, artery, up, down, up_share, opposite_down, opposite_share, reciprocal, involved, concordance) from (rec, lead, up, down).

    Reciprocal: an elevated lead of the territory and a depressed one opposite (Posterior: the latter alone; RV: V1 with two of
    RCA). Involved: two elevated leads (Posterior: two depressed ones opposite; RV: where it is reciprocal). Concordance: the share
    of the territory's leads that go its main way.
    """
    n = lambda flag, names: F.count_if(F.col(flag) & F.col("lead").isin(list(names))) if names else F.count_if(F.lit(False))
    wide = leads.groupBy("rec").agg(*[n(flag, side).alias(f"{a}_{role}_{flag}") for a, sides in ARTERIES.items() for role, side in zip(("own", "other"), sides, strict=True) for flag in ("up", "down")])
    found = []
    for a, (own, other) in ARTERIES.items():
        c = lambda role, flag, a=a: F.col(f"{a}_{role}_{flag}")
        share = lambda x, names: x / len(names) if names else F.lit(0.0)
        reciprocal = (c("own", "up") >= 1) & (c("other", "down") >= 1)
        involved = c("own", "up") >= 2
        if a == "Posterior":
            reciprocal, involved = c("other", "down") >= 1, c("other", "down") >= 2
        elif a == "RV":
            reciprocal = involved = (c("own", "up") >= 1) & (F.col("RCA_own_up") >= 2)
        found.append(F.struct(
            F.lit(a).alias("artery"), c("own", "up").alias("up"), c("own", "down").alias("down"), share(c("own", "up"), own).alias("up_share"), c("other", "down").alias("opposite_down"),
            share(c("other", "down"), other).alias("opposite_share"), reciprocal.alias("reciprocal"), involved.alias("involved"), share(F.greatest(c("own", "up"), c("own", "down")), own).alias("concordance"),
        ))
    return wide.select("rec", F.inline(F.array(*found)))


def diffuseness(leads: DataFrame) -> DataFrame:
    """(rec, reciprocal_index, abnormal_leads, abnormal_territories, diffuseness, contrast) from (rec, lead, dev, abnormal): a third
    for each pair of territories whose mean deviations have opposite signs, the share of abnormal leads, and the inferior
    mean less the anterior one (a territory without leads counts 0 there).

    Deviations count in whole millionths, so that signs and the rounding of the contrast to 4 digits are exact.
    """
    names = {"inferior": INFERIOR_LEADS, "anterior": ANTERIOR, "lateral": LATERAL}
    of = lambda x: F.col("lead").isin(list(x)) & F.col("dev").isNotNull()
    whole = F.round(F.col("dev") * 1_000_000).cast("long")
    sums = [F.coalesce(F.sum(F.when(of(x), whole)), F.lit(0)).alias(k) for k, x in names.items()]
    counts = [F.greatest(F.count_if(of(x)), F.lit(1)).alias(f"{k}_of") for k, x in names.items()]
    hits = [F.count_if(F.col("abnormal") & F.col("lead").isin(list(x))).alias(f"{k}_n") for k, x in names.items()]
    wide = leads.groupBy("rec").agg(*sums, *counts, *hits, F.count_if("abnormal").alias("abnormal_leads"), F.count("*").alias("leads"))
    pairs = (("inferior", "anterior"), ("inferior", "lateral"), ("anterior", "lateral"))
    opposite = sum((F.signum(a) * F.signum(b) < 0).cast("int") for a, b in pairs)
    territories_hit = sum((F.col(f"{k}_n") > 0).cast("int") for k in names)
    over = F.expr("inferior * anterior_of - anterior * inferior_of")
    under = F.expr("100 * inferior_of * anterior_of")
    wide = wide.withColumn("over", over).withColumn("under", under)
    contrast = F.expr("cast(sign(over) as int) * ((2 * abs(over) + under) div (2 * under)) / 10000D")
    return wide.select("rec", F.round(opposite / 3, 4).alias("reciprocal_index"), "abnormal_leads", territories_hit.alias("abnormal_territories"), F.round(F.col("abnormal_leads") / F.col("leads"), 4).alias("diffuseness"), contrast.alias("contrast"))


def variant_mechanism(amp: Column, ref_amp: Column, angle: Column, ref_angle: Column, phase: Column, rr: Column) -> tuple[Column, Column, Column, Column]:
    """(similarity, residual, phase share, mechanism) of a P variant against the reference wave."""
    similarity = wave_similarity(amp + 1e-6, ref_amp + 1e-6, F.abs(angle - ref_angle))
    residual = F.abs(amp - ref_amp) / (ref_amp + 1e-6)
    share = F.abs(phase) / F.greatest(rr, F.lit(1.0))
    kind = F.when((similarity >= 0.85) & (residual >= 0.3) & (share > 0.4), "coexistent").when((similarity < 0.7) & (residual < 0.3) & (share < 0.3), "ectopic").otherwise("indeterminate")
    return similarity, residual, share, kind
