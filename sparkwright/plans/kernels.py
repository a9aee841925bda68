"""Signal kernels on sequences of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.operators import kernels as K
from sparkwright.operators import sequences as Q
from sparkwright.plans.neighbours import vectors
from sparkwright.plans.sequences import rr, valued

R = lambda df, *names: df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _triples(spark, d):
    return valued(spark, d).select("key", "i", F.col("rr").alias("a"), (F.col("i") % 7).cast("double").alias("b"), (F.col("rr") % 30).alias("c"))


def dbscan_events(spark, d):
    return K.event_clusters(_triples(spark, d))


def beat_clusters(spark, d):
    return R(K.beat_clusters(_triples(spark, d)), "share", "alternation")


def morphology_clusters(spark, d):
    rows = _triples(spark, d).join(rr(spark, d).select("key", "i", "rr"), ["key", "i"])
    out = K.morphology_clusters(rows, ["a", "b", "c"])
    return out.select("key", "k", F.round("dominant", 6).alias("dominant"), F.size("minority").alias("n_minority"), F.size("premature").alias("n_premature"))


def rr_mixture(spark, d):
    return R(K.interval_mixtures(rr(spark, d)), "low", "high")


def rhythm_panorama(spark, d):
    """All tokens of each key: AAR (one mode), HIR (modes hardly apart) or REG, STA or LRR, FLT2 or FLT3, BIGEM or TRIGEM, PVCx
    and PACx. Some users' intervals are folded to two or three modes, so that every kind occurs."""
    mode = F.pmod("key", F.lit(6))
    folded = F.when(mode == 1, 600 + F.col("i") % 2 * 600 + F.col("rr") % 20).when(mode == 2, 400 + F.col("i") % 3 * 400 + F.col("rr") % 20).when(mode == 3, 500 + F.col("rr") % 20).when(mode == 4, 1200 + F.col("rr") % 20)
    rows = rr(spark, d).withColumn("rr", F.coalesce(folded, F.col("rr")))
    regular, irregular = Q.regularity(F.col("cv"), F.col("pnn50"))
    windows = Q.sliding_windows(rows).groupBy("key").agg(F.avg(regular.cast("int")).alias("reg"), F.avg(irregular.cast("int")).alias("irr"))
    rate = rows.groupBy("key").agg((60000 / F.avg("rr")).alias("bpm"))
    both = windows.join(K.interval_clusters(rows), "key").join(rate, "key").join(Q.premature(rows).select("key", "pvcs", "pacs"), "key", "left")
    return both.select("key", F.array_join(Q.panorama(), ",").alias("tokens"), "k")


def lomb_scargle(spark, d):
    return K.band_rhythms(rr(spark, d).withColumn("angle", F.col("rr") % 60))


def amplitude_modulation(spark, d):
    return R(K.modulations(rr(spark, d)), "depth")


def event_periodicity(spark, d):
    return K.periodicity(rr(spark, d).withColumn("flag", F.col("rr") > 1500))


def recording_features(spark, d):
    """Features of recordings of twelve leads, synthesised from vectors: spike trains whose beats carry the mean of every
    twelfth value."""
    t = F.sequence(F.lit(0), F.lit(1499))
    means = F.expr("transform(sequence(0, 11), k -> aggregate(filter(v, (x, j) -> j % 12 = k), 0D, (s, x) -> s + x) / ceil((size(v) - k) / 12D))")
    # what depends on the sample alone is made once
    beat = lambda at, width: F.transform(t, lambda i: F.exp(-F.pow((i % 250 - at) / F.lit(width), 2)))
    wave = lambda k: F.transform(t, lambda i: 0.01 * F.sin(i * 0.11 + k))
    shape = F.broadcast(spark.range(1).select(beat(120, 6.0).alias("r"), beat(190, 15.0).alias("t"), F.array(*[wave(k) for k in range(12)]).alias("w")))  # one row
    lead = lambda k: F.zip_with(F.zip_with("r", "t", lambda r, t: r + F.col("m")[k] * t), F.col("w")[k], lambda x, w: x + w)
    spread = vectors(spark, d).select("id", means.alias("m")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").crossJoin(shape)  # a recording is work
    few = spread.select("id", F.lit(250.0).alias("fs"), F.array(*[lead(k) for k in range(12)]).alias("leads"))
    return K.recording_features(few).groupBy("lead", "name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def savgol_batch(spark, d):
    s = vectors(spark, d).select("id", K.savgol("v").alias("s"))
    return s.select("id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x), 6).alias("power"), F.round(F.col("s")[10], 6).alias("s10"))


def trapezoid_integral(spark, d):
    x = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: i / F.lit(10.0))
    return vectors(spark, d).select("id", F.round(K.trapezoid(x, F.col("v")), 6).alias("area"))


QUERIES = {f.__name__: f for f in (dbscan_events, beat_clusters, morphology_clusters, rr_mixture, rhythm_panorama, lomb_scargle, amplitude_modulation, event_periodicity, recording_features, savgol_batch, trapezoid_integral)}
V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
ORACLES = {
    "savgol_batch": f"WITH {V}, s AS (SELECT id, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i > 2 AND i <= len(v) - 2 THEN (-3 * v[i - 2] + 12 * v[i - 1] + 17 * v[i] + 12 * v[i + 1] - 3 * v[i + 2]) / 35 ELSE v[i] END) AS s FROM v) SELECT id, round(list_sum(list_transform(s, lambda x: x * x)), 6) AS power, round(s[11], 6) AS s10 FROM s",
    "trapezoid_integral": f"WITH {V} SELECT id, round(list_sum(list_transform(range(1, len(v)), lambda i: (v[i] + v[i + 1]) / 20)), 6) AS area FROM v",
    "event_periodicity": "WITH raw AS (SELECT user_id AS key, row_number() OVER w - 2 AS i, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), rr AS (SELECT key, i, (300 + (us // 1000000) % 1701)::DOUBLE AS rr FROM raw WHERE i >= 0), f AS (SELECT key, i - lag(i) OVER (PARTITION BY key ORDER BY i) AS g FROM rr WHERE rr > 1500), c AS (SELECT key, count(g) AS n, count(DISTINCT g) AS k, count(*) FILTER (g = 1) AS ones FROM f GROUP BY key) SELECT u.key, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN k = 1 THEN 'every_nth' WHEN ones > 0 THEN 'grouped' ELSE 'random' END AS pattern FROM (SELECT DISTINCT key FROM rr) u LEFT JOIN c ON u.key = c.key",
}
