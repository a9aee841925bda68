"""Component rules and measures on components made from order lines: an order is a recording, its lines are components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.signals import LEADS
from sparkwright.operators import rules as U
from sparkwright.operators import sequences as Q
from sparkwright.plans.sequences import _WIN, E, rr
from sparkwright.session import table


def components(spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    wave = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "N", "QRS").otherwise("T")
    lead = F.element_at(F.lit(LEADS), (F.col("l_partkey") % 12 + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("rec"), lead.alias("lead"), F.col("l_linenumber").cast("long").alias("beat"), wave.alias("wave"),
        (F.col("l_quantity") / 25 - 1).alias("amp"), ((F.col("l_suppkey") * 37 + F.col("l_partkey")) % 400 - 200).cast("double").alias("center"),
        (F.col("l_discount") * 500 + F.col("l_tax") * 100 + 3).alias("sigma"), (F.col("l_partkey") * 16 + F.col("l_linenumber")).cast("long").alias("i"),
    )


def deviations(spark, d: str) -> DataFrame:
    return components(spark, d).groupBy("rec", "lead").agg(F.round(F.avg(F.col("amp") * 3), 6).alias("dev"))


C = f"""c AS (SELECT l_orderkey AS rec, {LEADS!r}[l_partkey % 12 + 1] AS lead, l_linenumber::BIGINT AS beat, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'N' THEN 'QRS' ELSE 'T' END AS wave,
 l_quantity / 25 - 1 AS amp, ((l_suppkey * 37 + l_partkey) % 400 - 200)::DOUBLE AS center, l_discount * 500 + l_tax * 100 + 3 AS sigma, (l_partkey * 16 + l_linenumber)::BIGINT AS i FROM lineitem),
 dv AS (SELECT rec, lead, round(avg(amp * 3), 6) AS dev FROM c GROUP BY rec, lead)"""


def _plain(c):
    """Rounded, without a negative zero."""
    r = F.round(c, 6)
    return F.when(r == 0, 0.0).otherwise(r)


R = lambda df, *names: df.select(*[_plain(c).alias(c) if c in names else F.col(c) for c in df.columns])


def extractor_rules(spark, d):
    out = U.evaluate(components(spark, d))
    return out.agg(*[F.count_if(r.name).alias(r.name) for r in U.RULES], F.count("*").alias("n"))


def contiguous_leads(spark, d):
    rule = U.Rule("hit", "QRS", "amp > 0", 2, contiguous=True)
    return U.evaluate(components(spark, d), [rule]).where("hit").select("rec")


def frontal_axis(spark, d):
    wide = deviations(spark, d).groupBy("rec").agg(F.max(F.when(F.col("lead") == "I", F.col("dev"))).alias("i"), F.max(F.when(F.col("lead") == "aVF", F.col("dev"))).alias("f"))
    angle, band = U.axis(F.col("f"), F.col("i"))
    return wide.where("i is not null and f is not null").select("rec", F.round(angle, 4).alias("angle"), band.alias("band"))


def voltage_criteria(spark, d):
    c = table(spark, d, "part").select("p_partkey", *[((F.col("p_size") * k) % 37 / F.lit(10.0)).alias(f"x{k}") for k in (1, 3, 5, 7, 11)])
    return c.select("p_partkey", F.array_join(U.hypertrophy(F.col("x1"), F.col("x3"), F.col("x5"), F.col("x7"), F.col("x11"), F.col("p_partkey") % 2 == 0), ",").alias("criteria"))


def st_grades(spark, d):
    x = components(spark, d).withColumn("t", U.st_threshold(F.col("lead"), F.col("beat") * 20, F.col("rec") % 2 == 0))
    return x.groupBy("lead", U.st_grade(F.col("amp") / F.col("t")).alias("grade")).agg(F.count("*").alias("n"))


def torsade_risk(spark, d):
    p = F.col("p_partkey")
    points, grade = U.torsade_points(p % 2 == 0, p % 3 == 0, (p % 10) / 10, p % 7, (p % 5) / 10, (p % 4) / 2)
    return table(spark, d, "part").groupBy(points.alias("points"), grade.alias("grade")).agg(F.count("*").alias("n"))


def exclusive_rules(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    return sets.groupBy(F.array_join(U.exclusive_conflicts(F.col("s"), [["A", "R"], ["N", "R"]]), ";").alias("conflict")).agg(F.count("*").alias("n"))


def territory_pattern(spark, d):
    return R(U.territories(deviations(spark, d)), "mean", "extreme")


def deviation_summary(spark, d):
    return R(U.deviation_summary(deviations(spark, d)), "max", "min", "up", "down", "balance")


def clinical_intervals(spark, d):
    return U.clinical_intervals(components(spark, d))


def qt_fusion(spark, d):
    out = U.trimmed_fusion(components(spark, d).select("rec", "lead", F.col("center").alias("value")))
    return R(out, "fused")


def qt_corrected(spark, d):
    """QT of each order, from its components, over the mean interval of its customer's key."""
    rows = rr(spark, d).groupBy("key").agg(F.avg("rr").alias("rr"))
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec"), F.col("o_custkey").alias("key"))
    qt = U.clinical_intervals(components(spark, d)).where("qt_ms > 0").join(own, "rec").join(rows, "key")
    return qt.select("rec", F.round(U.bazett(F.col("qt_ms"), F.col("rr")), 4).alias("qtc"), (U.bazett(F.col("qt_ms"), F.col("rr")) > 450).alias("long"))


def consensus_center(spark, d):
    return R(U.consensus_center(components(spark, d).withColumn("snr", F.col("amp") * 10)), "center")


def candidate_choice(spark, d):
    rows = components(spark, d).select("rec", "i", F.col("center").alias("offset"), F.col("amp").alias("confidence"), F.col("sigma").alias("duration"), F.when(F.col("wave") == "P", "energy").otherwise("lead").alias("method"))
    return R(U.best_candidate(rows), "score")


def _st_leads(spark, d) -> DataFrame:
    """(rec, lead, a60 ... a120, shape, slope): amplitudes that drift with the offset, by the sizes of an order's lines."""
    dv = deviations(spark, d)
    step = (F.col("dev") * 100 % 7 - 3) / 100
    shape = F.when(F.col("dev") < -1, "downsloping").when(F.col("dev") < 0, "scooped").when(F.col("dev") < 1, "horizontal").otherwise("upsloping")
    return dv.select("rec", "lead", *[F.round(F.col("dev") / 10 + step * k, 6).alias(f"a{60 + 20 * k}") for k in range(4)], shape.alias("shape"), F.round(step / 10, 6).alias("slope"))


def _cases(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec"), "o_custkey")
    return o.select("rec", (F.col("o_custkey") % 160 + 100).alias("qt"), (F.col("o_custkey") % 80).alias("age"), (F.col("rec") % 2 == 0).alias("male"), (F.col("o_custkey") % 3 == 0).alias("depressed"))


def quorum_patterns(spark, d):
    """How many orders show each ST pattern: quorums of two, six and eight leads, read at an offset that QT decides."""
    found = U.st_patterns(_st_leads(spark, d), _cases(spark, d))
    return found.agg(*[F.count_if(c).alias(c) for c in found.columns if c != "rec"], F.count("*").alias("recordings"))


def st_pattern_rows(spark, d):
    return U.st_patterns(_st_leads(spark, d), _cases(spark, d))


def reciprocal_patterns(spark, d):
    flags = _st_leads(spark, d).select("rec", "lead", (F.col("a80") >= 0.1).alias("up"), ((F.col("a80") <= U.DEPRESSION) & (F.col("lead") != "aVR")).alias("down"))
    return U.reciprocal_pairs(flags)


def territory_shapes(spark, d):
    return R(U.territory_shapes(_st_leads(spark, d)), "slope")


def component_filter(spark, d):
    """P components that are no artefacts of QRS or noise, and what they say of each order."""
    return R(U.atrial_energy(components(spark, d).withColumn("amp", F.col("amp") / F.when(F.col("wave") == "P", 8).otherwise(1))), "area", "top")


def beat_outliers(spark, d):
    """Intervals more than a fifth off the mean of their key."""
    m = rr(spark, d).groupBy("key").agg(F.avg("rr").alias("m"))
    return rr(spark, d).join(m, "key").where(F.abs(F.col("rr") - F.col("m")) > 0.2 * F.col("m")).groupBy("key").agg(F.count("*").alias("n"))


def width_outliers(spark, d):
    """Components more than 20 ms wider (four sigmas) than the average one of their order and wave."""
    wide = components(spark, d).select("rec", "wave", "i", (4 * F.col("sigma")).alias("width"))
    mean = wide.groupBy("rec", "wave").agg(F.avg("width").alias("mean"))
    return wide.join(mean, ["rec", "wave"]).where(F.round(F.col("width") - F.col("mean"), 6) > 20).select("rec", "wave", "i")


def interval_containment(spark, d):
    """Components whose center lies in the P, QRS or T window of their recording."""
    x = F.col("center")
    region = F.when(x < -75, "P").when(x <= 80, "QRS").otherwise("T")
    return components(spark, d).groupBy(region.alias("region"), "wave").agg(F.count("*").alias("n"))


def wave_similarity(spark, d):
    order = "rec = rec2 and i < i2"
    a = components(spark, d).where("wave = 'T' and amp > 0").select("rec", "i", "amp", "center")
    b = a.select(F.col("rec").alias("rec2"), F.col("i").alias("i2"), F.col("amp").alias("amp2"), F.col("center").alias("center2"))
    both = a.join(b, F.expr(order))
    s = U.wave_similarity(F.col("amp"), F.col("amp2"), F.col("center") - F.col("center2"))
    return both.groupBy("rec").agg(F.count("*").alias("pairs"), _plain(F.max(s)).alias("best"))


def risk_composite(spark, d):
    c = U.composite([(F.col("l_quantity") / 40, 0.5), (F.col("l_discount") * 12, 0.3), (1 - F.col("l_tax") * 20, 0.2)])
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.max(c), 6).alias("top"))


def alternation_regression(spark, d):
    """Intervals of which, for every third user, each second one is a fifth longer."""
    longer = (F.col("key") % 3 == 0) & (F.col("i") % 2 == 1)
    return U.regression_alternation(rr(spark, d).withColumn("rr", F.when(F.col("key") % 3 == 0, 800 + F.col("rr") % 50).otherwise(F.col("rr")) * F.when(longer, 1.2).otherwise(1.0)))


def dense(spark, d: str) -> DataFrame:
    """components of which those of thirty orders in a row share a recording."""
    return components(spark, d).withColumn("i", F.col("i") * 100_000 + F.col("rec")).withColumn("rec", F.expr("rec div 30"))


def _measures(spark, d) -> DataFrame:
    rr_of = rr(spark, d).groupBy(F.col("key").alias("rec")).agg(F.avg("rr").alias("rr"))
    return U.lead_measures(dense(spark, d), rr_of)


LEAD_NAMES = [*(r.name for r in U.LEAD_RULES), *U.JOINT_RULES]


def lead_extractors(spark, d):
    out = U.evaluate_leads(_measures(spark, d))
    return out.agg(*[F.count_if(n).alias(n) for n in LEAD_NAMES], F.count("*").alias("n"))


def lead_extractor_rows(spark, d):
    """Which rules each recording meets, as one list."""
    out = U.evaluate_leads(_measures(spark, d))
    return out.select("rec", F.array_join(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in LEAD_NAMES])), ",").alias("rules"))


def recording_extractors(spark, d):
    """Rhythm rules: intervals of a user with the P and QRS components of the recording of that number."""
    h = Q.hrv(rr(spark, d))
    more = rr(spark, d).groupBy("key").agg(F.min("rr").alias("low"), F.max("rr").alias("high"))
    regular, irregular = Q.regularity(F.col("cv"), F.col("pnn50"))
    windows = Q.sliding_windows(rr(spark, d)).groupBy("key").agg(F.avg(regular.cast("int")).alias("regular"), F.avg(irregular.cast("int")).alias("irregular"))
    parts = dense(spark, d)
    p, ii = F.col("wave") == "P", F.col("lead") == "II"
    waves = parts.groupBy(F.col("rec").alias("key")).agg(
        F.max(F.when(p, F.col("amp") / 10)).alias("p_amp"), F.max(F.when(F.col("wave") == "QRS", 4 * F.col("sigma"))).alias("qrs_ms"), (F.count_if(ii) > 0).alias("has_ii"),
        F.count_if(p & ii).alias("p_ii_n"), F.min(F.when(p & ii, F.col("amp"))).alias("p_ii_low"), (F.count_distinct(F.when(p & ii, F.col("beat"))) / F.count_distinct("beat")).alias("p_share"),
    )
    st = U.lead_measures(parts, rr(spark, d).select(F.col("key").alias("rec"), "rr").limit(0)).where("lead in ('V2', 'V3', 'V4')")
    st = st.groupBy(F.col("rec").alias("key")).agg(F.count_if(F.expr("t_start - qrs_end < 60")).alias("short_st"))
    both = h.join(more, "key").join(windows, "key").join(waves, "key", "left").join(st, "key", "left").join(U.p_variation(parts).withColumnRenamed("rec", "key"), "key", "left")
    cases = both.select(
        F.col("key").alias("rec"), "n", (60000 / F.col("mean")).alias("bpm"), "cv", "pnn50", "rmssd", "sdnn", "regular", "irregular", "p_amp", "qrs_ms", (F.col("low") / F.col("mean")).alias("shortest"), (F.col("high") / F.col("mean")).alias("longest"),
        "has_ii", "p_ii_n", "p_ii_low", "p_share", "short_st", "p_beats", "p_amp_cv", "p_dur_cv", (F.col("key") % 10 / 10).alias("dominant"), (F.col("key") % 7 / 20).alias("ectopy"),
    )
    out = U.evaluate_recordings(cases)
    return out.select("rec", F.array_join(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in U.RECORDING_RULES])), ",").alias("rules"))


def amplitude_alternans(spark, d):
    rows = dense(spark, d).withColumn("beat", F.col("i"))
    out = None
    for wave in ("T", "QRS"):
        one = U.alternans(U.beat_series(rows, wave)).withColumn("wave", F.lit(wave))
        out = one if out is None else out.unionByName(one)
    return out.select("rec", "lead", "wave", "n", *[F.round(c, 6).alias(c) for c in ("flip_share", "cv", "half_gap")], "by_flips", "by_halves")


def _flags(spark, d) -> DataFrame:
    return _st_leads(spark, d).select("rec", "lead", F.col("a80").alias("dev"), (F.col("a80") >= 0.1).alias("up"), ((F.col("a80") <= U.DEPRESSION) & (F.col("lead") != "aVR")).alias("down"))


def artery_fractions(spark, d):
    return R(U.artery_fractions(_flags(spark, d)), "up_share", "opposite_share", "concordance")


def st_diffuseness(spark, d):
    return U.diffuseness(_flags(spark, d).withColumn("abnormal", F.col("up") | F.col("down")))


def p_variants(spark, d):
    """P components against the mean P wave of all recordings: how many of each mechanism."""
    p = components(spark, d).where("wave = 'P'").select("amp", "center", (F.col("i") % 360).cast("double").alias("angle"), (F.abs("amp") + 0.05).alias("size"))
    mean = p.agg(F.avg("size").alias("ref_size"), F.avg("angle").alias("ref_angle"), F.avg("center").alias("ref_center"))
    s, r, share, kind = U.variant_mechanism(F.col("size"), F.col("ref_size"), F.col("angle"), F.col("ref_angle"), F.col("center") - F.col("ref_center"), F.lit(400.0))
    return p.join(F.broadcast(mean)).groupBy(kind.alias("mechanism")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(n) for c, n in ((s, "similarity"), (r, "residual"), (share, "phase"))])  # one row


QUERIES = {f.__name__: f for f in (
    extractor_rules, contiguous_leads, frontal_axis, voltage_criteria, st_grades, torsade_risk, exclusive_rules, territory_pattern, deviation_summary,
    clinical_intervals, qt_fusion, qt_corrected, consensus_center, candidate_choice, quorum_patterns, component_filter, beat_outliers,
    interval_containment, wave_similarity, risk_composite, alternation_regression, st_pattern_rows, reciprocal_patterns, territory_shapes, width_outliers,
    lead_extractors, lead_extractor_rows, recording_extractors, amplitude_alternans, artery_fractions, st_diffuseness, p_variants,
)}


def _sql_plain(query: str, *names: str) -> str:
    """A query whose named columns have no negative zero."""
    return f"SELECT * REPLACE ({', '.join(f'CASE WHEN {n} = 0 THEN 0 ELSE {n} END AS {n}' for n in names)}) FROM ({query})"


def _rule_sql(r: U.Rule) -> str:
    cond = f"wave = '{r.wave}' AND lead IN ({', '.join(repr(x) for x in r.leads)}) AND ({r.test})"
    if not r.contiguous:
        return f"(SELECT count(*) FROM (SELECT rec FROM c WHERE {cond} GROUP BY rec HAVING count(DISTINCT lead) >= {r.least})) AS {r.name}"
    return f"(SELECT count(DISTINCT a.rec) FROM (SELECT DISTINCT rec, list_position({LEADS!r}, lead) AS p FROM c WHERE {cond}) a JOIN (SELECT DISTINCT rec, list_position({LEADS!r}, lead) AS p FROM c WHERE {cond}) b ON a.rec = b.rec AND b.p = a.p + 1) AS {r.name}"


_ST = """st AS (SELECT rec, lead, dev, round(dev / 10, 6) AS a60, round(dev / 10 + (dev * 100 % 7 - 3) / 100, 6) AS a80, round(dev / 10 + (dev * 100 % 7 - 3) / 100 * 2, 6) AS a100, round(dev / 10 + (dev * 100 % 7 - 3) / 100 * 3, 6) AS a120, CASE WHEN dev < -1 THEN 'downsloping' WHEN dev < 0 THEN 'scooped' WHEN dev < 1 THEN 'horizontal' ELSE 'upsloping' END AS shape, round((dev * 100 % 7 - 3) / 1000, 6) AS slope FROM dv)"""
_PAT = f"""WITH {C}, {_ST}, o AS (SELECT o_orderkey AS rec, o_custkey % 160 + 100 AS qt, o_custkey % 80 AS age, o_orderkey % 2 = 0 AS male, o_custkey % 3 = 0 AS depressed FROM orders),
 a AS (SELECT st.rec, lead, shape, CASE WHEN qt <= 140 THEN a60 WHEN qt <= 180 THEN a80 WHEN qt <= 220 THEN a100 ELSE a120 END AS amp, depressed, CASE WHEN lead IN ('V2', 'V3') THEN CASE WHEN NOT male THEN 0.15::DOUBLE WHEN age < 40 THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END ELSE 0.1::DOUBLE END AS t FROM st JOIN o ON st.rec = o.rec),
 f AS (SELECT *, amp >= CASE WHEN depressed AND lead IN ('V1', 'V2') THEN greatest(t, 0.2::DOUBLE) ELSE t END AS up, amp <= -0.05 AND lead <> 'aVR' AS down FROM a),
 pat AS (SELECT rec, count(*) FILTER (up AND lead IN ('V1', 'V2', 'V3', 'V4')) >= 2 AS anterior, count(*) FILTER (up AND lead IN ('II', 'III', 'aVF')) >= 2 AS inferior, count(*) FILTER (up AND lead IN ('I', 'aVL', 'V5', 'V6')) >= 2 AS "lateral", count(*) FILTER (down AND lead IN ('V1', 'V2', 'V3')) >= 2 AS posterior,
 count(*) FILTER (down) >= 6 AS diffuse_depression, count(*) FILTER (amp > t / 2) >= 8 AS pericarditis, count(*) FILTER (down AND lead IN ('V5', 'V6', 'I', 'aVL') AND shape IN ('downsloping', 'scooped')) >= 2 AS strain FROM f GROUP BY rec)"""
_ALT = f"""WITH {E}, s AS (SELECT key, i, CASE WHEN key % 3 = 0 THEN (800 + rr % 50) * CASE WHEN i % 2 = 1 THEN 1.2::DOUBLE ELSE 1 END ELSE rr END AS rr FROM rr), m AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, median(rr) OVER (PARTITION BY key) AS med FROM s),
 x AS (SELECT key, i, rr / med AS norm, sum(rr / med) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS run FROM m WHERE n >= 8 AND med > 0), y AS (SELECT *, norm - run - avg(norm - run) OVER (PARTITION BY key) AS hp, stddev_pop(norm) OVER (PARTITION BY key) AS sd FROM x),
 w AS ({" UNION ALL ".join(f"SELECT a.key, a.i, {k} AS size, (avg(b.hp) FILTER (b.i % 2 = 0) - avg(b.hp) FILTER (b.i % 2 = 1)) / 2 AS b1, var_pop(b.hp) AS v, avg(b.norm) FILTER (b.i % 2 = 0) - avg(b.norm) FILTER (b.i % 2 = 1) AS dd, median(b.norm) AS mm FROM y a JOIN y b ON a.key = b.key AND b.i BETWEEN a.i AND a.i + {k - 1} WHERE a.sd >= 0.02 GROUP BY a.key, a.i HAVING count(*) = {k}" for k in (12, 10, 8))}),
 r AS (SELECT key, size, round(abs(b1) / (sqrt(greatest(0, v - b1 * b1)) + 1e-9), 6) AS ratio, round(100 * abs(dd) / (abs(mm) + 1e-9), 6) AS delta FROM w)"""
_TERR = ", ".join(f"('{t}', '{role}', '{lead}')" for t, pair in U.TERRITORIES.items() for role, leads in zip(("primary", "reciprocal"), pair, strict=True) for lead in leads)
_DENSE = "dn AS (SELECT rec // 30 AS rec, lead, beat, wave, amp, center, sigma, i * 100000 + rec AS i FROM c)"
_W = lambda f, w: f"{f} FILTER (wave = '{w}')"
_MEAS = f"""WITH {C}, {E}, {_DENSE}, m AS (SELECT key AS rec, avg(rr) AS rr FROM rr GROUP BY key), x AS (SELECT rec, lead,
 {_W("arg_max(amp, (abs(amp), i, amp, center, sigma))", "T")} AS t_amp, {_W("max(amp)", "T")} AS t_pos, {_W("min(amp)", "T")} AS t_neg, {_W("arg_max(center, (amp, i, center, sigma))", "T")} AS t_pos_at, {_W("arg_min(center, (amp, i, center, sigma))", "T")} AS t_neg_at,
 {_W("count(*)", "T")} AS t_n, {_W("max(center + sigma)", "QRS")} AS qrs_end_near, list_sort({_W("list(center)", "QRS")}) AS qc, count(*) FILTER (wave = 'QRS' AND center > 80 AND amp > 0 AND amp < 0.2) AS qrs_late_low, count(*) FILTER (wave = 'QRS' AND center < -20 AND sigma > 20) AS qrs_early_wide,
 count(*) FILTER (wave = 'QRS' AND amp > 0.1) AS qrs_high, count(*) FILTER (wave = 'QRS' AND amp < -0.1) AS qrs_low, max(center) FILTER (wave = 'QRS' AND amp > 0.1) AS r_last_at, {_W("min(center - 2 * sigma)", "T")} AS t_start, {_W("max(center + 2 * sigma)", "T")} AS t_end, {_W("max(sigma)", "T")} AS t_widest, {_W("min(sigma)", "T")} AS t_narrowest,
 {_W("count(*)", "P")} AS p_n, {_W("max(amp)", "P")} AS p_pos, {_W("min(amp)", "P")} AS p_neg, {_W("min(center)", "P")} AS p_first_at, {_W("max(center)", "P")} AS p_last_at, {_W("min(center - 2 * sigma)", "P")} AS p_start, {_W("max(center + 2 * sigma)", "P")} AS p_end,
 {_W("count(*)", "QRS")} AS qrs_n, count(*) FILTER (wave = 'QRS' AND amp > 0) AS qrs_up, count(*) FILTER (wave = 'QRS' AND amp < 0) AS qrs_down, {_W("arg_max(amp, (abs(amp), i, amp, center, sigma))", "QRS")} AS qrs_amp, {_W("max(abs(amp))", "QRS")} AS qrs_size,
 {_W("max(amp)", "QRS")} AS r, {_W("min(amp)", "QRS")} AS s, {_W("arg_max(center, (amp, i, center, sigma))", "QRS")} AS r_at, {_W("arg_min(amp, (center, i, amp, sigma))", "QRS")} AS qrs_first, {_W("arg_min(sigma, (center, i, amp, sigma))", "QRS")} AS qrs_first_sigma,
 {_W("min(center)", "QRS")} AS qrs_first_at, {_W("arg_max(amp, (center, i, amp, sigma))", "QRS")} AS qrs_last, {_W("max(center)", "QRS")} AS qrs_last_at, {_W("min(center - 2 * sigma)", "QRS")} AS qrs_start, {_W("max(center + 2 * sigma)", "QRS")} AS qrs_end FROM dn GROUP BY rec, lead),
 lm AS (SELECT x.*, CASE WHEN len(qc) > 0 THEN 1 + len(list_filter(range(2, len(qc) + 1), lambda k: qc[k] - qc[k - 1] > 15)) ELSE 0 END AS qrs_peaks, rr FROM x LEFT JOIN m ON x.rec = m.rec),
 hit AS ({" UNION ALL ".join(f"SELECT rec, '{r.name}' AS rule FROM (SELECT DISTINCT rec, list_position({LEADS!r}, lead) AS p FROM lm WHERE lead IN ({', '.join(repr(x) for x in r.leads)}) AND ({r.test})) " + (f"GROUP BY rec HAVING count(*) >= {r.least}" if not r.contiguous else f"QUALIFY p = lag(p, {r.least - 1}) OVER (PARTITION BY rec ORDER BY p) + {r.least - 1}") for r in U.LEAD_RULES)}),
 h0 AS (SELECT DISTINCT rec, rule FROM hit), hw AS (SELECT rec, {", ".join(f"bool_or(rule = '{r.name}') AS {r.name}" for r in U.LEAD_RULES)} FROM h0 GROUP BY rec),
 h AS (SELECT * FROM h0 {" ".join(f"UNION ALL SELECT rec, '{n}' FROM hw WHERE {t}" for n, t in U.JOINT_RULES.items())})"""
_ORDER = [*(r.name for r in U.LEAD_RULES), *U.JOINT_RULES]
_CNT = lambda flag, leads: f"count(*) FILTER ({flag} AND lead IN ({', '.join(repr(x) for x in leads)}))" if leads else "0::BIGINT"
_OTHER = f"{C}, {_DENSE}".replace("c AS (SELECT l_orderkey", "cc AS (SELECT l_orderkey").replace("FROM c GROUP", "FROM cc GROUP").replace("FROM c)", "FROM cc)")
_Q = "CASE WHEN {s} < 1 THEN 'none' WHEN {s} < 2 THEN 'mild' WHEN {s} < 3 THEN 'moderate' ELSE 'severe' END"

ORACLES = {
    "extractor_rules": f"WITH {C} SELECT {', '.join(_rule_sql(r) for r in U.RULES)}, (SELECT count(DISTINCT rec) FROM c) AS n",
    "contiguous_leads": f"WITH {C}, q AS (SELECT DISTINCT rec, list_position({LEADS!r}, lead) AS p FROM c WHERE wave = 'QRS' AND amp > 0) SELECT DISTINCT a.rec FROM q a JOIN q b ON a.rec = b.rec AND b.p = a.p + 1",
    "frontal_axis": f"WITH {C}, w AS (SELECT a.rec, a.dev AS i, b.dev AS f FROM dv a JOIN dv b ON a.rec = b.rec WHERE a.lead = 'I' AND b.lead = 'aVF') SELECT rec, round(degrees(atan2(f, i)), 4) AS angle, CASE WHEN degrees(atan2(f, i)) < -90 THEN 'extreme' WHEN degrees(atan2(f, i)) < -30 THEN 'left' WHEN degrees(atan2(f, i)) > 90 THEN 'right' ELSE 'normal' END AS band FROM w",
    "voltage_criteria": "WITH p AS (SELECT p_partkey, p_size % 37 / 10.0 AS a, p_size * 3 % 37 / 10.0 AS b, p_size * 5 % 37 / 10.0 AS c, p_size * 7 % 37 / 10.0 AS d, p_size * 11 % 37 / 10.0 AS e FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN a + greatest(b, c) >= 3.5 THEN 'sokolow' END, CASE WHEN d + e >= CASE WHEN p_partkey % 2 = 0 THEN 2.0 ELSE 2.8 END THEN 'cornell' END, CASE WHEN d >= 1.1 THEN 'avl' END) AS criteria FROM p",
    "st_grades": f"WITH {C}, t AS (SELECT lead, abs(amp / CASE WHEN lead IN ('V2', 'V3') THEN CASE WHEN rec % 2 <> 0 THEN 0.15::DOUBLE WHEN beat * 20 < 40 THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END ELSE 0.1::DOUBLE END) AS s FROM c) SELECT lead, {_Q.format(s='s')} AS grade, count(*) AS n FROM t GROUP BY ALL",
    "torsade_risk": "WITH p AS (SELECT 2 * (p_partkey % 2 = 0)::INT + 3 * (p_partkey % 3 = 0)::INT + (p_partkey % 10 > 5)::INT + (p_partkey % 7 >= 4)::INT + (p_partkey % 5 > 2)::INT + (p_partkey % 4 > 3)::INT AS points FROM part) SELECT points, CASE WHEN points >= 6 THEN 'high' WHEN points >= 4 THEN 'moderate' WHEN points >= 2 THEN 'low' ELSE 'negligible' END AS grade, count(*) AS n FROM p GROUP BY ALL",
    "exclusive_rules": "WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS s FROM lineitem GROUP BY 1) SELECT concat_ws(';', CASE WHEN list_contains(s, 'A') AND list_contains(s, 'R') THEN 'A/R' END, CASE WHEN list_contains(s, 'N') AND list_contains(s, 'R') THEN 'N/R' END) AS conflict, count(*) AS n FROM s GROUP BY 1",
    "territory_pattern": f"WITH {C}, t(territory, role, lead) AS (VALUES {_TERR}), j AS (SELECT rec, dev, territory, role FROM dv JOIN t ON dv.lead = t.lead) SELECT rec, territory, count(*) FILTER (role = 'primary') AS n, count(*) FILTER (role = 'primary' AND dev >= 1) AS elevated, count(*) FILTER (role = 'reciprocal' AND dev <= -1) AS reciprocal, round(avg(dev) FILTER (role = 'primary'), 6) AS mean, round(last(dev ORDER BY abs(dev), dev) FILTER (role = 'primary'), 6) AS extreme FROM j GROUP BY rec, territory",
    "deviation_summary": f"WITH {C}, s AS (SELECT rec, max(dev) AS mx, min(dev) AS mn, coalesce(sum(dev) FILTER (dev > 0), 0) AS up, coalesce(sum(-dev) FILTER (dev < 0), 0) AS down, count(*) FILTER (dev > 0) AS n_up, count(*) FILTER (dev < 0) AS n_down FROM dv GROUP BY rec) SELECT rec, round(mx, 6) AS max, round(mn, 6) AS min, round(up, 6) AS up, round(down, 6) AS down, n_up, n_down, round(coalesce((up - down) / nullif(up + down, 0), 0), 6) AS balance FROM s",
    "clinical_intervals": f"WITH {C}, b AS (SELECT rec, min(center - 2 * sigma) FILTER (wave = 'P') AS p0, max(center + 2 * sigma) FILTER (wave = 'P') AS p1, min(center - 2 * sigma) FILTER (wave = 'QRS') AS q0, max(center + 2 * sigma) FILTER (wave = 'QRS') AS q1, max(center + 2 * sigma) FILTER (wave = 'T') AS t1 FROM c GROUP BY rec) SELECT rec, round(CASE WHEN p1 - p0 > 0 THEN p1 - p0 ELSE 0 END, 2) AS p_ms, round(CASE WHEN q1 - q0 > 0 THEN q1 - q0 ELSE 0 END, 2) AS qrs_ms, round(CASE WHEN q0 - p0 > 0 THEN q0 - p0 ELSE 0 END, 2) AS pr_ms, round(CASE WHEN t1 - q0 > 0 THEN t1 - q0 ELSE 0 END, 2) AS qt_ms FROM b",
    "qt_fusion": f"WITH {C}, m AS (SELECT rec, lead, median(center) AS m FROM c GROUP BY rec, lead), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY m, lead) AS r, count(*) OVER (PARTITION BY rec) AS n FROM m), t AS (SELECT *, avg(m) FILTER (r > floor(n * 0.25) AND r <= n - floor(n * 0.25)) OVER (PARTITION BY rec) AS t FROM r) SELECT rec, round(avg(m) FILTER (abs(m - t) <= 60), 6) AS fused, count(*) AS leads FROM t GROUP BY rec",
    "qt_corrected": f"WITH {C}, {E}, m AS (SELECT key, avg(rr) AS rr FROM rr GROUP BY key), b AS (SELECT rec, min(center - 2 * sigma) FILTER (wave = 'QRS') AS q0, max(center + 2 * sigma) FILTER (wave = 'T') AS t1 FROM c GROUP BY rec), q AS (SELECT rec, round(CASE WHEN t1 - q0 > 0 THEN t1 - q0 ELSE 0 END, 2) / sqrt(rr / 1000) AS q FROM b JOIN orders ON o_orderkey = rec JOIN m ON m.key = o_custkey WHERE t1 - q0 > 0) SELECT rec, round(q, 4) AS qtc, q > 450 AS long FROM q",
    "consensus_center": f"WITH {C}, k AS (SELECT rec, i, center, pow(10, 0.05::DOUBLE * (amp * 10)) AS w FROM c WHERE amp * 10 >= -3), l AS (SELECT rec, i, center, least(w, 8 * min(w) OVER (PARTITION BY rec)) AS w, quantile_cont(center, 0.25) OVER (PARTITION BY rec) AS q1, quantile_cont(center, 0.75) OVER (PARTITION BY rec) AS q3 FROM k), f AS (SELECT * FROM l WHERE center BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), r AS (SELECT rec, center, sum(w) OVER (PARTITION BY rec ORDER BY center, i) AS run, sum(w) OVER (PARTITION BY rec) / 2 AS half FROM f) SELECT rec, round(CASE WHEN max(center) - min(center) <= 80 THEN min(center) FILTER (run >= half) END, 6) AS center FROM r GROUP BY rec",
    "candidate_choice": f"WITH {C}, s AS (SELECT rec, i, CASE WHEN abs(center) <= 20 THEN 2 WHEN abs(center) <= 60 THEN 1 ELSE -1 END + least(1, greatest(0, amp)) + CASE WHEN sigma BETWEEN 40 AND 160 THEN 1.0::DOUBLE WHEN sigma BETWEEN 20 AND 240 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN wave = 'P' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS score FROM c) SELECT rec, i, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY rec ORDER BY score DESC, i) = 1",
    "quorum_patterns": _PAT + " SELECT " + ", ".join(f'count(*) FILTER (pat."{c}") AS "{c}"' for c in ("anterior", "inferior", "lateral", "posterior", "diffuse_depression", "pericarditis", "strain")) + ", count(*) AS recordings FROM pat",
    "component_filter": f"WITH {C}, k AS (SELECT rec, wave, sigma, amp / CASE WHEN wave = 'P' THEN 8 ELSE 1 END AS amp FROM c), o AS (SELECT rec, coalesce(max(abs(amp)) FILTER (wave = 'QRS'), 1) AS qrs, greatest(0.008::DOUBLE, 1.2::DOUBLE * coalesce(quantile_cont(abs(amp), 0.1) FILTER (wave = 'P'), 0)) AS least FROM k GROUP BY rec), p AS (SELECT k.rec, abs(amp) AS a, sigma FROM k JOIN o ON k.rec = o.rec WHERE wave = 'P' AND amp <= 0.25 * qrs AND NOT (sigma > 25 AND amp < 0.05 * qrs) AND sigma >= 3 AND abs(amp) >= least), s AS (SELECT rec, count(*) AS kept, sum(a * sigma * 2.5066::DOUBLE) AS area, max(a) AS top FROM p GROUP BY rec) SELECT o.rec, coalesce(kept, 0) AS kept, round(coalesce(area, 0), 6) AS area, round(coalesce(top, 0), 6) AS top, CASE WHEN area > 0.5 AND top > least THEN 'P_ACTIVITY_PRESENT' ELSE 'AF_LIKELY' END AS state FROM o LEFT JOIN s ON o.rec = s.rec",
    "beat_outliers": f"WITH {E}, m AS (SELECT *, avg(rr) OVER (PARTITION BY key) AS m FROM rr) SELECT key, count(*) AS n FROM m WHERE abs(rr - m) > 0.2 * m GROUP BY key",
    "interval_containment": f"WITH {C} SELECT CASE WHEN center < -75 THEN 'P' WHEN center <= 80 THEN 'QRS' ELSE 'T' END AS region, wave, count(*) AS n FROM c GROUP BY ALL",
    "wave_similarity": f"WITH {C}, t AS (SELECT rec, i, amp, center FROM c WHERE wave = 'T' AND amp > 0) SELECT a.rec, count(*) AS pairs, round(max(exp(-abs(ln(a.amp / b.amp))) * cos(radians(a.center - b.center))), 6) AS best FROM t a JOIN t b ON a.rec = b.rec AND a.i < b.i GROUP BY a.rec",
    "risk_composite": "WITH c AS (SELECT l_returnflag, least(1, greatest(0, l_quantity / 40)) * 0.5::DOUBLE + least(1, greatest(0, l_discount * 12)) * 0.3::DOUBLE + least(1, greatest(0, 1 - l_tax * 20)) * 0.2::DOUBLE AS c FROM lineitem) SELECT l_returnflag, round(avg(c), 6) AS mean, round(max(c), 6) AS top FROM c GROUP BY 1",
    "lead_extractors": _MEAS + " SELECT " + ", ".join(f"(SELECT count(*) FROM h WHERE rule = '{n}') AS {n}" for n in _ORDER) + ", (SELECT count(DISTINCT rec) FROM lm) AS n",
    "lead_extractor_rows": _MEAS + f" SELECT a.rec, coalesce(string_agg(rule, ',' ORDER BY list_position({_ORDER!r}, rule)), '') AS rules FROM (SELECT DISTINCT rec FROM lm) a LEFT JOIN h ON a.rec = h.rec GROUP BY a.rec",
    "recording_extractors": _WIN + f", {_OTHER}, d AS (SELECT key, rr, rr - lag(rr) OVER (PARTITION BY key ORDER BY i) AS d FROM rr), hv AS (SELECT key, count(*) AS n, avg(rr) AS mean, stddev_pop(rr) AS sdnn, sqrt(avg(d * d)) AS rmssd, 100 * avg(CASE WHEN d IS NOT NULL THEN (abs(d) >= 50)::INT END) AS pnn50, stddev_pop(rr) / avg(rr) AS cv, min(rr) / avg(rr) AS shortest, max(rr) / avg(rr) AS longest FROM d GROUP BY key), wv AS (SELECT rec AS key, max(amp / 10) FILTER (wave = 'P') AS p_amp, max(4 * sigma) FILTER (wave = 'QRS') AS qrs_ms, count(*) FILTER (lead = 'II') > 0 AS has_ii, count(*) FILTER (wave = 'P' AND lead = 'II') AS p_ii_n, min(amp) FILTER (wave = 'P' AND lead = 'II') AS p_ii_low, count(DISTINCT beat) FILTER (wave = 'P' AND lead = 'II') / count(DISTINCT beat) AS p_share FROM dn GROUP BY rec), sl AS (SELECT rec AS key, lead, min(center - 2 * sigma) FILTER (wave = 'T') - max(center + 2 * sigma) FILTER (wave = 'QRS') AS st FROM dn WHERE lead IN ('V2', 'V3', 'V4') GROUP BY rec, lead), ss AS (SELECT key, count(*) FILTER (st < 60) AS short_st FROM sl GROUP BY key), pb AS (SELECT rec AS key, beat, count(*) FILTER (wave = 'P') AS n, sum(abs(amp)) FILTER (wave = 'P') AS amp, sum(4 * sigma) FILTER (wave = 'P') AS dur, row_number() OVER (PARTITION BY rec ORDER BY beat) AS place FROM dn WHERE lead = 'II' GROUP BY rec, beat), pv AS (SELECT key, count(*) AS p_beats, round(coalesce(stddev_pop(amp) / nullif(avg(amp), 0), 0), 6) AS p_amp_cv, round(coalesce(stddev_pop(dur) / nullif(avg(dur), 0), 0), 6) AS p_dur_cv FROM pb WHERE place <= 15 AND n > 0 GROUP BY key), ca AS (SELECT has_ii, p_ii_n, p_ii_low, p_share, short_st, p_beats, p_amp_cv, p_dur_cv, hv.key % 10 / 10 AS dominant, hv.key % 7 / 20 AS ectopy, irregular::DOUBLE / windows AS irregular, hv.key AS rec, n, 60000 / mean AS bpm, cv, pnn50, rmssd, sdnn, shortest, longest, regular::DOUBLE / windows AS regular, p_amp, qrs_ms FROM hv JOIN reg ON hv.key = reg.key LEFT JOIN wv ON wv.key = hv.key LEFT JOIN ss ON ss.key = hv.key LEFT JOIN pv ON pv.key = hv.key) SELECT rec, concat_ws(',', " + ", ".join(f"CASE WHEN ({t})" + (f" AND NOT coalesce(({U.RECORDING_RULES['absolute_arrhythmia']}), false)" if n == "low_variability" else "") + f" THEN '{n}' END" for n, t in U.RECORDING_RULES.items()) + ") AS rules FROM ca",
    "amplitude_alternans": f"WITH {C}, {_DENSE}, s AS (SELECT rec, lead, wave, i AS beat, arg_max(amp, (abs(amp), amp)) AS amp FROM dn WHERE wave IN ('T', 'QRS') GROUP BY rec, lead, wave, i), o AS (SELECT *, row_number() OVER w AS pos, amp - lag(amp) OVER w AS d FROM s WINDOW w AS (PARTITION BY rec, lead, wave ORDER BY beat)), p AS (SELECT *, lag(d) OVER (PARTITION BY rec, lead, wave ORDER BY beat) AS d0 FROM o), a AS (SELECT rec, lead, wave, count(*) AS n, avg(CASE WHEN d0 IS NOT NULL THEN (d * d0 < 0)::INT END) AS f, abs(stddev_pop(amp) / nullif(avg(amp), 0)) AS v, abs((avg(amp) FILTER (pos % 2 = 0) - avg(amp) FILTER (pos % 2 = 1)) / nullif(avg(amp), 0)) AS g FROM p GROUP BY rec, lead, wave HAVING count(*) >= 8) SELECT rec, lead, wave, n, round(f, 6) AS flip_share, round(v, 6) AS cv, round(g, 6) AS half_gap, coalesce(f >= 0.7 AND v > 0.15, false) AS by_flips, coalesce(g > 0.15, false) AS by_halves FROM a",
    "artery_fractions": f"WITH {C}, {_ST}, f AS MATERIALIZED (SELECT rec, lead, a80 >= 0.1 AS up, a80 <= -0.05 AND lead <> 'aVR' AS down FROM st), w AS MATERIALIZED (SELECT rec, " + ", ".join(f"{_CNT('up', own)} AS u{k}, {_CNT('down', own)} AS d{k}, {_CNT('down', other)} AS o{k}" for k, (own, other) in enumerate(U.ARTERIES.values())) + f" FROM f GROUP BY rec), a AS (" + " UNION ALL ".join(f"SELECT rec, '{a}' AS artery, u{k} AS up, d{k} AS down, o{k} AS opposite_down, {len(own)} AS n, {len(other)} AS m, u{list(U.ARTERIES).index('RCA')} AS rca FROM w" for k, (a, (own, other)) in enumerate(U.ARTERIES.items())) + "), x AS (SELECT *, CASE artery WHEN 'Posterior' THEN opposite_down >= 1 WHEN 'RV' THEN up >= 1 AND rca >= 2 ELSE up >= 1 AND opposite_down >= 1 END AS reciprocal, CASE artery WHEN 'Posterior' THEN opposite_down >= 2 WHEN 'RV' THEN up >= 1 AND rca >= 2 ELSE up >= 2 END AS involved FROM a) SELECT rec, artery, up, down, round(coalesce(up / nullif(n, 0), 0), 6) AS up_share, opposite_down, round(coalesce(opposite_down / nullif(m, 0), 0), 6) AS opposite_share, reciprocal, involved, round(coalesce(greatest(up, down) / nullif(n, 0), 0), 6) AS concordance FROM x",
    "st_diffuseness": f"WITH {C}, {_ST}, f AS MATERIALIZED (SELECT rec, CASE WHEN lead IN ('II', 'III', 'aVF') THEN 'i' WHEN lead IN ('V1', 'V2', 'V3', 'V4') THEN 'a' WHEN lead IN ('I', 'aVL', 'V5', 'V6') THEN 'l' END AS t, round(a80 * 1000000)::BIGINT AS m, a80 >= 0.1 OR a80 <= -0.05 AND lead <> 'aVR' AS b FROM st), w AS (SELECT rec, " + ", ".join(f"coalesce(sum(m) FILTER (t = '{k}'), 0)::BIGINT AS {k}, greatest(count(*) FILTER (t = '{k}'), 1) AS n{k}, count(*) FILTER (b AND t = '{k}') AS h{k}" for k in "ial") + ", count(*) FILTER (b) AS n, count(*) AS k FROM f GROUP BY rec), o AS (SELECT *, i * na - a * ni AS ov, 100 * ni * na AS un FROM w) SELECT rec, round(((sign(i) * sign(a) < 0)::INT + (sign(i) * sign(l) < 0)::INT + (sign(a) * sign(l) < 0)::INT) / 3.0::DOUBLE, 4) AS reciprocal_index, n AS abnormal_leads, (hi > 0)::INT + (ha > 0)::INT + (hl > 0)::INT AS abnormal_territories, round(n::DOUBLE / k, 4) AS diffuseness, sign(ov)::BIGINT * ((2 * abs(ov) + un) // (2 * un)) / 10000.0::DOUBLE AS contrast FROM o",
    "p_variants": f"WITH {C}, p AS (SELECT center, (i % 360)::DOUBLE AS angle, abs(amp) + 0.05 AS size FROM c WHERE wave = 'P'), m AS (SELECT avg(size) AS rs, avg(angle) AS ra, avg(center) AS rc FROM p), v AS (SELECT exp(-abs(ln((size + 1e-6) / (rs + 1e-6)))) * cos(radians(abs(angle - ra))) AS s, abs(size - rs) / (rs + 1e-6) AS r, abs(center - rc) / 400 AS h FROM p, m) SELECT CASE WHEN s >= 0.85 AND r >= 0.3 AND h > 0.4 THEN 'coexistent' WHEN s < 0.7 AND r < 0.3 AND h < 0.3 THEN 'ectopic' ELSE 'indeterminate' END AS mechanism, count(*) AS n, round(avg(s), 6) AS similarity, round(avg(r), 6) AS residual, round(avg(h), 6) AS phase FROM v GROUP BY 1",
    "st_pattern_rows": _PAT + " SELECT * FROM pat",
    "reciprocal_patterns": f"WITH {C}, {_ST}, w AS (SELECT rec, count(*) FILTER (u AND lead IN ('V1', 'V2', 'V3', 'V4')) AS au, count(*) FILTER (d AND lead IN ('V1', 'V2', 'V3', 'V4')) AS ad, count(*) FILTER (u AND lead IN ('I', 'aVL', 'V5', 'V6')) AS lu, count(*) FILTER (d AND lead IN ('I', 'aVL', 'V5', 'V6')) AS ld, count(*) FILTER (u AND lead IN ('II', 'III', 'aVF')) AS iu, count(*) FILTER (d AND lead IN ('II', 'III', 'aVF')) AS id FROM (SELECT rec, lead, a80 >= 0.1 AS u, a80 <= -0.05 AND lead <> 'aVR' AS d FROM st) GROUP BY rec) SELECT rec, 'anterior' AS elevated, 'inferior' AS depressed FROM w WHERE au > 0 AND id > 0 UNION ALL SELECT rec, 'inferior', 'anterior' FROM w WHERE iu > 0 AND ad > 0 UNION ALL SELECT rec, 'lateral', 'inferior' FROM w WHERE lu > 0 AND id > 0 UNION ALL SELECT rec, 'inferior', 'lateral' FROM w WHERE iu > 0 AND ld > 0",
    "territory_shapes": f"WITH {C}, {_ST}, t(territory, lead, place) AS (VALUES " + ", ".join(f"('{t}', '{lead}', {i})" for t, own in (("anterior", U.ANTERIOR), ("inferior", U.INFERIOR_LEADS), ("lateral", U.LATERAL)) for i, lead in enumerate(own)) + "), j AS (SELECT rec, territory, shape, place, slope FROM st JOIN t ON st.lead = t.lead), k AS (SELECT rec, territory, shape, count(*) AS n, min(place) AS f FROM j GROUP BY ALL), b AS (SELECT rec, territory, shape FROM k QUALIFY row_number() OVER (PARTITION BY rec, territory ORDER BY n DESC, f) = 1), m AS (SELECT rec, territory, round(1000 * avg(slope), 6) AS slope FROM j GROUP BY ALL) SELECT b.rec, b.territory, shape, slope FROM b JOIN m ON b.rec = m.rec AND b.territory = m.territory",
    "width_outliers": f"WITH {C}, m AS (SELECT rec, wave, i, 4 * sigma AS w, avg(4 * sigma) OVER (PARTITION BY rec, wave) AS m FROM c) SELECT rec, wave, i FROM m WHERE round(w - m, 6) > 20",
    "alternation_regression": _ALT + " SELECT key, ratio, delta, size, ratio >= 0.9 AND delta >= 12 AS present FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY ratio DESC, delta DESC, size DESC) = 1",
}
for _name, _columns in {"territory_shapes": ["slope"], "territory_pattern": ["mean", "extreme"], "deviation_summary": ["max", "min", "up", "down", "balance"], "candidate_choice": ["score"], "wave_similarity": ["best"]}.items():
    ORACLES[_name] = _sql_plain(ORACLES[_name], *_columns)
