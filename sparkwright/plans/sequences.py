"""Sequence operators on the events of each user: an interval of s whole seconds stands for 300 + s mod 1701 ms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.operators import sequences as Q
from sparkwright.session import table


def raw(spark, d: str) -> DataFrame:
    return Q.intervals(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")


def rr(spark, d: str) -> DataFrame:
    return raw(spark, d).select("key", "i", (F.lit(300) + F.floor(F.col("us") / 1_000_000) % 1701).cast("double").alias("rr"))


def valued(spark, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return e.select(F.col("user_id").alias("key"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("rr"), "event_type")


E = """raw AS (SELECT user_id AS key, ts, row_number() OVER w - 2 AS i, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 rr AS (SELECT key, i, (300 + (us // 1000000) % 1701)::DOUBLE AS rr FROM raw WHERE i >= 0)"""
V = "v AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS rr, event_type FROM events)"
MED = "m AS (SELECT *, median(rr) OVER (PARTITION BY key) AS med FROM rr)"
R = lambda df, *names, digits=6: df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def inter_event_intervals(spark, d):
    return raw(spark, d).select("key", "i", "us")


def hrv_summary(spark, d):
    return R(Q.hrv(rr(spark, d)), "mean", "sdnn", "rmssd", "pnn50", "cv")


def mad_trim(spark, d):
    return Q.mad_trim(rr(spark, d))


def low_median_filter(spark, d):
    return Q.low_median_filter(rr(spark, d), 400.0)


def sliding_windows(spark, d):
    return R(Q.sliding_windows(rr(spark, d)), "mean", "cv", "pnn50")


def window_regularity(spark, d):
    regular, irregular = Q.regularity(F.col("cv"), F.col("pnn50"))
    w = Q.sliding_windows(rr(spark, d)).select("key", regular.alias("r"), irregular.alias("x"))
    return w.groupBy("key").agg(F.count("*").alias("windows"), F.count_if("r").alias("regular"), F.count_if("x").alias("irregular"))


def panorama_tokens(spark, d):
    """REG, STA, LRR and AAR (one mode assumed), PVCx and PACx of each key, joined by commas."""
    part = window_regularity(spark, d).select("key", (F.col("regular") / F.col("windows")).alias("reg"), (F.col("irregular") / F.col("windows")).alias("irr"))
    rate = rr(spark, d).groupBy("key").agg((60000 / F.avg("rr")).alias("bpm"))
    both = part.join(rate, "key").join(Q.premature(rr(spark, d)), "key", "left")
    tokens = F.array_compact(F.array(
        F.when(F.col("irr") >= 0.6, "AAR").when(F.col("reg") >= 0.6, "REG"),
        F.when((F.col("reg") >= 0.6) & (F.col("bpm") >= 100), "STA").when((F.col("reg") >= 0.6) & (F.col("bpm") < 60), "LRR"),
        F.when(F.col("pvcs") >= 3, "PVCx"), F.when(F.col("pacs") >= 3, "PACx"),
    ))
    return both.select("key", F.array_join(tokens, ",").alias("tokens"), F.round("bpm", 4).alias("bpm"))


def premature_pairs(spark, d):
    return Q.premature(rr(spark, d))


def sls_triplets(spark, d):
    return Q.short_long_short(rr(spark, d))


def bigeminy_pairs(spark, d):
    return Q.paired(rr(spark, d))


def trigeminy_triples(spark, d):
    return Q.tripled(rr(spark, d))


def label_runs(spark, d):
    """Runs of event types of each user: how many, the longest, and the share of changes (gaps and islands)."""
    runs = Q.value_runs(valued(spark, d), "event_type", "key")
    return runs.groupBy("key").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.round((F.count("*") - 1) / (F.sum("n") - 1), 6).alias("change_rate"))


def long_pause(spark, d):
    """Pauses of intervals of which every fifth user's are half as long again and every seventh user's twice as long."""
    longer = F.when(F.col("key") % 5 == 0, 1.5).when(F.col("key") % 7 == 0, 2.0).otherwise(1.0)
    return Q.long_pause(rr(spark, d).withColumn("rr", F.col("rr") * longer))


def true_runs(spark, d):
    """Runs of at least three intervals above 1000 as spans."""
    flagged = rr(spark, d).withColumn("hit", F.col("rr") > 1000)
    return Q.value_runs(flagged, "hit", "key").where("hit and n >= 3").select("key", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def transition_dominance(spark, d):
    return R(Q.return_map(valued(spark, d), "event_type"), "share")


def histogram_peaks(spark, d):
    return Q.histogram_peaks(rr(spark, d), 100.0)


def nearest_center(spark, d):
    rows = rr(spark, d)
    centers = Q.histogram_peaks(rows, 200.0).select("key", F.col("bin").alias("c"), (F.col("bin") * 200.0 + 100).alias("center"))
    return Q.nearest_center(rows, centers, 120.0).groupBy("key").agg(F.count("*").alias("n"), F.count("c").alias("assigned"))


def integer_ratios(spark, d):
    """Share of intervals within 0.1 of 1, 1.5, 2, 3 and 4 times the key's 10th percentile."""
    return Q.ratio_shares(rr(spark, d))


def acf_lags(spark, d):
    return R(Q.acf(rr(spark, d)), "acf")


def robust_stats(spark, d):
    return R(Q.robust(valued(spark, d), "key", "event_type"), "median", "mad", "iqr")


def alternation_index(spark, d):
    return R(Q.dft_alternation(rr(spark, d)), "index")


def alternation_argmax(spark, d):
    """The period with the strictly largest index (the shortest of equals) and whether it exceeds 1."""
    x = R(Q.dft_alternation(rr(spark, d)), "index")
    out = x.groupBy("key").agg(F.min_by("p", F.struct(-F.col("index"), F.col("p"))).alias("p"), F.max("index").alias("index"))
    return out.withColumn("present", F.col("index") > 1.0)


def circular_mean(spark, d):
    return R(Q.circular(valued(spark, d).withColumn("a", F.col("rr") % 360), "a", "event_type"), "mean", "length")


def angle_steps(spark, d):
    step = Q.wrap(F.col("rr") - F.lag("rr").over(Q.in_order()))
    return valued(spark, d).withColumn("step", step).groupBy("key").agg(F.round(F.avg(F.abs("step")), 6).alias("mean_step"), F.round(F.max(F.abs("step")), 6).alias("max_step"))


def weighted_median(spark, d):
    rows = valued(spark, d).withColumn("w", F.col("i") % 5 + 1)
    return Q.weighted_median(rows, "rr", "w", "key")


def weighted_quantile(spark, d):
    rows = valued(spark, d).withColumn("w", (F.col("i") % 5).cast("double"))
    return R(Q.weighted_quantile(rows, "rr", "w", 0.25, "key"), "quantile")


def rr_entropy(spark, d):
    return R(Q.entropy(rr(spark, d)), "entropy")


def component_merge(spark, d):
    """Groups of neighbouring intervals that differ by at most 300 from the one before and by a ratio of at most 2."""
    before = F.lag("rr").over(Q.in_order())
    ok = (F.abs(F.col("rr") - before) <= 300) & (F.greatest("rr", before) <= 2 * F.least("rr", before))
    groups = Q.merge_while(rr(spark, d), ok, "key").groupBy("key", "island").agg(F.count("*").alias("n"), F.sum("rr").alias("total"))
    return groups.groupBy("key").agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.max("total").alias("longest"))


def clipping_share(spark, d):
    """Share of values in runs of at least two near the key's extremes (outer five per cent of the range)."""
    b = valued(spark, d).withColumn("lo", F.min("rr").over(Q.by_key())).withColumn("hi", F.max("rr").over(Q.by_key()))
    edge = (F.col("rr") <= F.col("lo") + 0.05 * (F.col("hi") - F.col("lo"))) | (F.col("rr") >= F.col("hi") - 0.05 * (F.col("hi") - F.col("lo")))
    runs = Q.value_runs(b.withColumn("edge", edge), "edge", "key")
    return runs.groupBy("key").agg(F.round(F.coalesce(F.sum(F.when(F.col("edge") & (F.col("n") >= 2), F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("share"))


def _steps(spark, d) -> DataFrame:
    """Values held to a range and to steps, so that some clip and some are flat."""
    held = F.least(F.greatest("rr", F.lit(20.0)), F.lit(60.0))
    return valued(spark, d).withColumn("rr", F.when(F.floor(F.col("i") / 12) % 2 == 0, held).otherwise(F.lit(40.0)))


def clipped_runs(spark, d):
    return R(Q.clipped_share(_steps(spark, d)), "clipped")


def flat_windows(spark, d):
    return R(Q.flat_share(_steps(spark, d), 8), "flat")


def json_props_stats(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.min(k).alias("low"), F.max(k).alias("high"))


def tumbling_counts(spark, d):
    """Extension: events in windows of one hour by type."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def session_counts(spark, d):
    """Extension: sessions of each user, a gap of more than 30 minutes ends one."""
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("largest"))


QUERIES = {f.__name__: f for f in (
    inter_event_intervals, hrv_summary, mad_trim, low_median_filter, sliding_windows, window_regularity, panorama_tokens, premature_pairs,
    sls_triplets, bigeminy_pairs, trigeminy_triples, label_runs, long_pause, true_runs, transition_dominance, histogram_peaks,
    nearest_center, integer_ratios, acf_lags, robust_stats, alternation_index, alternation_argmax, circular_mean, angle_steps,
    weighted_median, weighted_quantile, rr_entropy, component_merge, clipping_share, clipped_runs, flat_windows, json_props_stats, tumbling_counts, session_counts,
)}

_STEPS = "s AS (SELECT key, i, CASE WHEN i // 12 % 2 = 0 THEN least(greatest(rr, 20.0::DOUBLE), 60.0::DOUBLE) ELSE 40.0::DOUBLE END AS rr FROM v)"
_WIN = f"""WITH {E}, c AS (SELECT key, i, rr, sum(rr) OVER (PARTITION BY key ORDER BY i) AS t1 FROM rr), k AS (SELECT key, max(t1) AS tot FROM c GROUP BY key),
 s AS (SELECT key, unnest(range(0, floor(greatest(tot - 10000, 0) / 2000)::BIGINT + 1)) AS w FROM k),
 x AS (SELECT s.key, s.w, c.i, c.rr, c.rr - lag(c.rr) OVER (PARTITION BY s.key, s.w ORDER BY c.i) AS d FROM s JOIN c ON s.key = c.key AND c.t1 - c.rr >= s.w * 2000 AND c.t1 <= s.w * 2000 + 10000),
 win AS (SELECT key, w, count(*) AS n, avg(rr) AS mean, stddev_pop(rr) / avg(rr) AS cv, 100 * avg(CASE WHEN d IS NOT NULL THEN (abs(d) >= 50)::INT END) AS pnn50 FROM x GROUP BY key, w HAVING count(*) >= 4),
 reg AS (SELECT key, count(*) AS windows, count(*) FILTER (cv <= 0.08 AND coalesce(pnn50, 0) <= 10) AS regular, count(*) FILTER (cv >= 0.12 OR coalesce(pnn50, 0) >= 20) AS irregular FROM win GROUP BY key)"""
_PREM = f"""pm AS (SELECT *, lead(rr) OVER (PARTITION BY key ORDER BY i) AS nxt FROM (SELECT *, median(rr) OVER (PARTITION BY key) AS med FROM rr)),
 prem AS (SELECT key, count(*) AS n, count(*) FILTER (rr < 0.8 * med AND i > 0 AND rr > 1.2 * med) AS pvcs, count(*) FILTER (rr < 0.9 * med AND rr >= 0.8 * med AND i > 0 AND rr > 1.05 * med) AS pacs,
 count(*) FILTER (rr < 0.8 * med AND nxt > 1.2 * med) AS pvcs_next, count(*) FILTER (rr < 0.9 * med AND rr >= 0.8 * med AND nxt > 1.05 * med) AS pacs_next FROM pm GROUP BY key HAVING count(*) >= 5)"""
_RUNS = "(SELECT key, {v}, min(i) AS start, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY key, {v} ORDER BY i) AS g FROM {t}) GROUP BY key, {v}, g)"
_HIST = "h AS (SELECT key, floor(rr / {w})::BIGINT AS bin, count(*) AS n FROM rr GROUP BY key, bin), peaks AS (SELECT a.key, a.bin, a.n FROM h a LEFT JOIN h l ON a.key = l.key AND l.bin = a.bin - 1 LEFT JOIN h r ON a.key = r.key AND r.bin = a.bin + 1 JOIN (SELECT key, max(n) AS top FROM h GROUP BY key) t ON a.key = t.key WHERE a.n > coalesce(l.n, 0) AND a.n > coalesce(r.n, 0) AND a.n >= 0.35 * top AND a.n >= 3)"
_DFT = f"""WITH {E}, a AS (SELECT key, count(*) AS n, median(rr) AS med FROM rr GROUP BY key), b AS (SELECT r.key, median(abs(r.rr - a.med)) AS mad FROM rr r JOIN a ON r.key = a.key GROUP BY r.key),
 s AS (SELECT r.key, p.p, any_value(a.n) AS n, any_value(a.med) AS med, any_value(b.mad) AS mad, sum((r.rr - a.med) * cos(2 * pi() * r.i / p.p)) AS re, sum((r.rr - a.med) * sin(2 * pi() * r.i / p.p)) AS im
 FROM rr r JOIN a ON r.key = a.key JOIN b ON r.key = b.key, (SELECT unnest([2, 3, 4])::INT AS p) p GROUP BY r.key, p.p),
 dft AS (SELECT key, p, round(CASE WHEN n < 2 * p OR mad < greatest(0.01 * greatest(abs(med), 1e-3), 1e-3) THEN 0 ELSE sqrt(re * re + im * im) / n / mad END, 6) AS index FROM s)"""

ORACLES = {
    "inter_event_intervals": f"WITH {E} SELECT key, i, us FROM raw WHERE i >= 0",
    "hrv_summary": f"WITH {E}, x AS (SELECT key, rr, rr - lag(rr) OVER (PARTITION BY key ORDER BY i) AS d FROM rr) SELECT key, count(rr) AS n, round(avg(rr), 6) AS mean, round(stddev_pop(rr), 6) AS sdnn, round(sqrt(avg(d * d)), 6) AS rmssd, round(100 * avg(CASE WHEN d IS NOT NULL THEN (abs(d) >= 50)::INT END), 6) AS pnn50, round(stddev_pop(rr) / avg(rr), 6) AS cv FROM x GROUP BY key",
    "mad_trim": f"WITH {E}, a AS (SELECT * FROM rr WHERE rr BETWEEN 300 AND 2000), m AS (SELECT *, median(rr) OVER (PARTITION BY key) AS med FROM a), n AS (SELECT *, median(abs(rr - med)) OVER (PARTITION BY key) AS mad FROM m) SELECT key, i, rr FROM n WHERE abs(rr - med) <= 3.5 * 1.4826 * (mad + 1e-9)",
    "low_median_filter": f"WITH {E}, a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rr, i) AS r, count(*) OVER (PARTITION BY key) AS n FROM rr), m AS (SELECT key, rr AS mid FROM a WHERE r = ceil(n / 2.0)) SELECT rr.key, i, rr.rr FROM rr JOIN m ON rr.key = m.key WHERE abs(rr.rr - mid) <= 400",
    "sliding_windows": _WIN + " SELECT key, w, n, round(mean, 6) AS mean, round(cv, 6) AS cv, round(pnn50, 6) AS pnn50 FROM win",
    "window_regularity": _WIN + " SELECT * FROM reg",
    "panorama_tokens": _WIN + f", {_PREM}, f AS (SELECT r.key, r.regular::DOUBLE / windows AS rg, irregular::DOUBLE / windows AS ir, pvcs, pacs, (SELECT 60000 / avg(rr) FROM rr q WHERE q.key = r.key) AS bpm FROM reg r LEFT JOIN prem ON r.key = prem.key) SELECT key, concat_ws(',', CASE WHEN ir >= 0.6 THEN 'AAR' WHEN rg >= 0.6 THEN 'REG' END, CASE WHEN rg >= 0.6 AND bpm >= 100 THEN 'STA' WHEN rg >= 0.6 AND bpm < 60 THEN 'LRR' END, CASE WHEN pvcs >= 3 THEN 'PVCx' END, CASE WHEN pacs >= 3 THEN 'PACx' END) AS tokens, round(bpm, 4) AS bpm FROM f",
    "premature_pairs": f"WITH {E}, {_PREM} SELECT * FROM prem",
    "sls_triplets": f"WITH {E}, {MED}, x AS (SELECT *, lead(rr) OVER w AS b, lead(rr, 2) OVER w AS c FROM m WINDOW w AS (PARTITION BY key ORDER BY i)) SELECT key, i FROM x WHERE rr < 0.8 * med AND b > 1.2 * med AND c < 0.8 * med",
    "bigeminy_pairs": f"WITH {E}, p AS (SELECT a.key, a.rr AS a, b.rr AS b FROM rr a JOIN rr b ON a.key = b.key AND b.i = a.i + 1 WHERE a.i % 2 = 0) SELECT key, count(*) AS pairs, count(*) FILTER (a < 0.8 * b) AS hits, count(*) >= 3 AND count(*) FILTER (a < 0.8 * b) >= 0.75 * count(*) AS present FROM p GROUP BY key",
    "trigeminy_triples": f"WITH {E}, p AS (SELECT a.key, (a.rr + b.rr) / 2 AS m, c.rr AS c FROM rr a JOIN rr b ON a.key = b.key AND b.i = a.i + 1 JOIN rr c ON a.key = c.key AND c.i = a.i + 2 WHERE a.i % 3 = 0) SELECT key, count(*) AS triples, count(*) FILTER (c < 0.8 * m) AS hits, count(*) >= 2 AND count(*) FILTER (c < 0.8 * m) >= 0.67 * count(*) AS present FROM p GROUP BY key",
    "label_runs": f"WITH {V}, r AS {_RUNS.format(v='event_type', t='v')} SELECT key, count(*) AS runs, max(n) AS longest, round((count(*) - 1)::DOUBLE / (sum(n) - 1), 6) AS change_rate FROM r GROUP BY key",
    "long_pause": f"WITH {E.replace('rr AS (', 'rr0 AS (', 1)}, rr AS (SELECT key, i, rr * CASE WHEN key % 5 = 0 THEN 1.5::DOUBLE WHEN key % 7 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS rr FROM rr0) SELECT key, max(rr) AS longest, max(rr) > 2 * avg(rr) OR max(rr) > 2000 AS present, CASE WHEN max(rr) <= 2 * avg(rr) AND max(rr) <= 2000 THEN 'none' WHEN max(rr) > 3000 THEN 'critical' WHEN max(rr) > 2500 THEN 'severe' WHEN max(rr) > 2000 THEN 'significant' ELSE 'moderate' END AS grade FROM rr GROUP BY key",
    "true_runs": f"WITH {E}, f AS (SELECT *, rr > 1000 AS hit FROM rr), r AS {_RUNS.format(v='hit', t='f')} SELECT key, start, start + n - 1 AS \"end\" FROM r WHERE hit AND n >= 3",
    "transition_dominance": f"WITH {V}, p AS (SELECT key, event_type AS a, lead(event_type) OVER (PARTITION BY key ORDER BY i) AS b FROM v), c AS (SELECT key, a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, a, b) AS r FROM c) SELECT key, sum(n)::BIGINT AS pairs, round(sum(n) FILTER (r <= 2)::DOUBLE / sum(n), 6) AS share FROM r GROUP BY key",
    "histogram_peaks": f"WITH {E}, {_HIST.format(w='100.0')} SELECT * FROM peaks",
    "nearest_center": f"WITH {E}, {_HIST.format(w='200.0')}, x AS (SELECT rr.key, i, min(abs(bin * 200.0 + 100 - rr.rr)) AS dist FROM rr LEFT JOIN peaks ON rr.key = peaks.key GROUP BY rr.key, i) SELECT key, count(*) AS n, count(*) FILTER (dist <= 120) AS assigned FROM x GROUP BY key",
    "integer_ratios": f"WITH {E}, b AS (SELECT *, quantile_cont(rr, 0.1) OVER (PARTITION BY key) AS b FROM rr) SELECT key, " + ", ".join(f"round(avg((abs(rr / b - {x}) <= 0.1)::INT), 6) AS r{str(x).replace('.', '_')}" for x in (1, 1.5, 2, 3, 4)) + " FROM b GROUP BY key",
    "acf_lags": f"WITH {E}, s AS (SELECT key, count(*) AS n, avg(rr) AS m, var_pop(rr) AS v FROM rr GROUP BY key), l AS (SELECT unnest([1, 2, 3, 4])::INT AS lag), p AS (SELECT s.key, l.lag, any_value(n) AS n, any_value(v) AS v, sum((a.rr - m) * (b.rr - m)) AS x, count(b.rr) AS pairs FROM s CROSS JOIN l JOIN rr a ON a.key = s.key LEFT JOIN rr b ON b.key = s.key AND b.i = a.i + l.lag GROUP BY s.key, l.lag) SELECT key, lag, round(CASE WHEN n < 5 OR v < 1e-12 OR pairs < 4 THEN 0 ELSE x / (n * v) END, 6) AS acf FROM p",
    "robust_stats": f"WITH {V}, m AS (SELECT *, median(rr) OVER (PARTITION BY key, event_type) AS med FROM v) SELECT key, event_type, count(*) AS n, round(any_value(med), 6) AS median, round(median(abs(rr - med)), 6) AS mad, round(quantile_cont(rr, 0.75) - quantile_cont(rr, 0.25), 6) AS iqr FROM m GROUP BY key, event_type",
    "alternation_index": _DFT + " SELECT * FROM dft",
    "alternation_argmax": _DFT + " SELECT key, p, index, index > 1.0 AS present FROM dft QUALIFY row_number() OVER (PARTITION BY key ORDER BY index DESC, p) = 1",
    "circular_mean": f"WITH {V}, c AS (SELECT event_type, avg(sin(radians(rr % 360))) AS s, avg(cos(radians(rr % 360))) AS c, count(*) AS n FROM v GROUP BY event_type) SELECT event_type, n, round(degrees(atan2(s, c)), 6) AS mean, round(sqrt(s * s + c * c), 6) AS length FROM c",
    "angle_steps": f"WITH {V}, s AS (SELECT key, rr - lag(rr) OVER (PARTITION BY key ORDER BY i) + 180 AS x FROM v), t AS (SELECT key, x - 360 * floor(x / 360) - 180 AS step FROM s) SELECT key, round(avg(abs(step)), 6) AS mean_step, round(max(abs(step)), 6) AS max_step FROM t GROUP BY key",
    "weighted_median": f"WITH {V}, w AS (SELECT *, i % 5 + 1 AS w FROM v), r AS (SELECT *, sum(w) OVER (PARTITION BY key ORDER BY rr, i) AS run, sum(w) OVER (PARTITION BY key) / 2.0 AS half FROM w) SELECT key, min(rr) AS median FROM r WHERE run >= half GROUP BY key",
    "weighted_quantile": f"WITH {V}, w AS (SELECT *, CASE WHEN sum(i % 5) OVER (PARTITION BY key) > 0 THEN (i % 5)::DOUBLE ELSE 1 END AS w FROM v), c AS (SELECT *, sum(w) OVER (PARTITION BY key ORDER BY rr, i) / sum(w) OVER (PARTITION BY key) AS cdf FROM w), l AS (SELECT *, lag(cdf) OVER o AS c0, lag(rr) OVER o AS v0 FROM c WINDOW o AS (PARTITION BY key ORDER BY rr, i)) SELECT key, round(min(coalesce(v0 + (rr - v0) * (0.25 - c0) / nullif(cdf - c0, 0), rr)), 6) AS quantile FROM l WHERE cdf >= 0.25 AND coalesce(c0, -1) < 0.25 GROUP BY key",
    "rr_entropy": f"WITH {E}, b AS (SELECT key, rr, min(rr) OVER (PARTITION BY key) AS lo, max(rr) OVER (PARTITION BY key) AS hi FROM rr), c AS (SELECT key, CASE WHEN hi = lo THEN 0 ELSE least(floor((rr - lo) / ((hi - lo) / 10)), 9) END AS b, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY key) AS p FROM c) SELECT key, round(-sum(p * ln(p)), 6) AS entropy, sum(n)::BIGINT AS n FROM p GROUP BY key",
    "component_merge": f"WITH {E}, b AS (SELECT *, lag(rr) OVER (PARTITION BY key ORDER BY i) AS p FROM rr), f AS (SELECT *, sum(CASE WHEN abs(rr - p) <= 300 AND greatest(rr, p) <= 2 * least(rr, p) AND p IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY i) AS g FROM b), s AS (SELECT key, g, count(*) AS n, sum(rr) AS t FROM f GROUP BY key, g) SELECT key, count(*) AS groups, max(n) AS largest, max(t) AS longest FROM s GROUP BY key",
    "clipping_share": f"WITH {V}, b AS (SELECT *, min(rr) OVER (PARTITION BY key) AS lo, max(rr) OVER (PARTITION BY key) AS hi FROM v), f AS (SELECT *, rr <= lo + 0.05 * (hi - lo) OR rr >= hi - 0.05 * (hi - lo) AS edge FROM b), r AS {_RUNS.format(v='edge', t='f')} SELECT key, round(coalesce(sum(n) FILTER (edge AND n >= 2), 0)::DOUBLE / sum(n), 6) AS share FROM r GROUP BY key",
    "clipped_runs": f"WITH {V}, {_STEPS}, b AS (SELECT *, min(rr) OVER (PARTITION BY key) AS lo, max(rr) OVER (PARTITION BY key) - min(rr) OVER (PARTITION BY key) + 1e-9 AS span FROM s), f AS (SELECT *, CASE WHEN rr - lo < 0.001 * span THEN 1 WHEN lo + span - rr < 0.001 * span THEN 2 ELSE 0 END AS side FROM b), r AS {_RUNS.format(v='side', t='f')} SELECT key, round(CASE WHEN sum(n) < 16 THEN 0 ELSE coalesce(sum(n) FILTER (side > 0 AND n >= 3), 0)::DOUBLE / sum(n) END, 6) AS clipped FROM r GROUP BY key",
    "flat_windows": f"WITH {V}, {_STEPS}, k AS (SELECT key, count(*) AS n, greatest(0.005::DOUBLE * (max(rr) - min(rr) + 1e-9), 0.015::DOUBLE) AS least FROM s GROUP BY key), w AS (SELECT a.key, a.i, stddev_pop(b.rr) AS sd FROM s a JOIN s b ON a.key = b.key AND b.i BETWEEN a.i AND a.i + 7 WHERE a.i % 4 = 0 GROUP BY a.key, a.i HAVING count(*) = 8) SELECT k.key, round(coalesce(avg((sd < least)::INT) FILTER (n >= 16), 0), 6) AS flat FROM k LEFT JOIN w ON k.key = w.key GROUP BY k.key",
    "json_props_stats": "WITH e AS (SELECT event_type, (props::JSON->>'k')::BIGINT AS k FROM events) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, min(k) AS low, max(k) AS high FROM e GROUP BY event_type",
    "tumbling_counts": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "session_counts": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS largest FROM c GROUP BY user_id",
}
