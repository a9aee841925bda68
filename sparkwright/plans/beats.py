"""Rules on beats: components of order lines by beat, and intervals of the users with the recording's number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.operators import beats as B
from sparkwright.plans.sequences import E, rr
from sparkwright.session import table


def components(spark, d: str) -> DataFrame:
    """(rec, lead, beat, wave, amp, center, sigma): a customer is a recording, its orders in order are the beats, of which some lack a wave."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    beats = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("os"))  # one customer's orders
    beats = beats.select(F.col("o_custkey").alias("rec"), F.posexplode("os").alias("beat", "o"))
    wave = F.explode(F.array(*[F.struct(F.lit(lead).alias("lead"), F.lit(k).alias("k"), F.lit(w).alias("wave")) for k, (lead, w) in enumerate([("II", "P"), ("II", "QRS"), ("V1", "P"), ("V1", "QRS"), ("I", "P"), ("aVF", "P")])]))
    rows = beats.select("rec", "beat", F.col("o.o_orderkey").alias("o"), wave.alias("w")).select("rec", "beat", "o", "w.*")
    rows = rows.where((F.col("o") * 7 + F.col("k") * 5) % 11 != 0)
    amp = ((F.col("o") * (F.col("k") + 3)) % 41 - F.when(F.col("lead").isin("I", "aVF"), 20).otherwise(0)) / F.lit(100.0)
    return rows.select("rec", "lead", "beat", "wave", amp.alias("amp"), F.lit(0.0).alias("center"), F.lit(10.0).alias("sigma"))


def intervals(spark, d: str) -> DataFrame:
    """(rec, i, rr): a user's intervals, of which every third user's take turns."""
    turn = F.when((F.col("key") % 3 == 0) & (F.col("i") % 2 == 1), 0.5).when((F.col("key") % 5 == 0) & (F.col("i") % 9 == 4), 2.5).otherwise(1.0)
    return rr(spark, d).select(F.col("key").alias("rec"), "i", (turn * (700 + F.col("rr") % 100)).alias("rr"))


def beat_rules(spark, d):
    """What each recording meets of the rules on series of beats, with their measures."""
    series, rows, parts = B.p_series(components(spark, d)), intervals(spark, d), components(spark, d)
    found = [
        B.atrial_bigeminy(rows, series).where("present").select("rec", F.lit("atrial_bigeminy").alias("rule"), F.round("share", 6).alias("measure")),
        B.dropped_beats(series).select("rec", F.lit("dropped_beats").alias("rule"), F.col("dropped").cast("double").alias("measure")),
        B.premature_atrial(rows, series).select("rec", F.lit("premature_atrial").alias("rule"), F.round("share", 6).alias("measure")),
        B.sinus_arrest(rows).select("rec", F.lit("sinus_arrest").alias("rule"), F.col("longest").alias("measure")),
        B.p_alternans(series).select("rec", F.concat(F.lit("p_alternans_"), "lead").alias("rule"), F.col("percent").alias("measure")),
        B.wandering_pacemaker(parts, series).select("rec", F.lit("wandering_pacemaker").alias("rule"), F.col("width").alias("measure")),
    ]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def conduction(spark, d):
    """P events (clicks) with the next QRS event (views and purchases) of each user within ten hours."""
    e = table(spark, d, "events").select(F.col("user_id").alias("rec"), F.when(F.col("event_type") == "click", "P").when(F.col("event_type").isin("view", "purchase"), "QRS").alias("wave"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"))
    return B.conduction(e, 36_000_000.0).withColumn("mean_pr", F.round("mean_pr", 3))


QUERIES = {f.__name__: f for f in (beat_rules, conduction)}
_PARTS = [("II", "P"), ("II", "QRS"), ("V1", "P"), ("V1", "QRS"), ("I", "P"), ("aVF", "P")]
_VALUES = ", ".join(f"({k}, '{lead}', '{w}')" for k, (lead, w) in enumerate(_PARTS))
ORACLES = {
    "beat_rules": f"""
WITH {E.replace("rr AS (", "r0 AS (", 1)}, rr AS (SELECT key AS rec, i, (700 + rr % 100) * CASE WHEN key % 3 = 0 AND i % 2 = 1 THEN 0.5::DOUBLE WHEN key % 5 = 0 AND i % 9 = 4 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS rr FROM r0),
b AS (SELECT o_custkey AS rec, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS beat, o_orderkey AS o FROM orders), p(k, lead, wave) AS (VALUES {_VALUES}),
c AS (SELECT rec, lead, beat, wave, ((o * (k + 3)) % 41 - CASE WHEN lead IN ('I', 'aVF') THEN 20 ELSE 0 END) / 100.0::DOUBLE AS amp FROM b, p WHERE (o * 7 + k * 5) % 11 <> 0),
s0 AS (SELECT rec, lead, beat, bool_or(wave = 'P') AS p, bool_or(wave = 'QRS') AS q, coalesce(sum(abs(amp)) FILTER (wave = 'P'), 0) AS size FROM c GROUP BY rec, lead, beat), s AS (SELECT *, max(beat) OVER (PARTITION BY rec, lead) + 1 AS beats FROM s0),
m AS (SELECT *, avg(rr) OVER (PARTITION BY rec) AS mean, count(*) OVER (PARTITION BY rec) AS n, lead(rr) OVER (PARTITION BY rec ORDER BY i) AS nx FROM rr),
bg AS (SELECT rec, count(*) FILTER (rr > 0.90 * mean AND nx < 0.85 * mean) / (max(n) / 2) AS share FROM m WHERE i % 2 = 0 AND nx IS NOT NULL AND n >= 6 AND rec IN (SELECT rec FROM s WHERE lead = 'II' AND beats >= 6) GROUP BY rec),
t AS (SELECT *, lag(beat) OVER w AS b0, lag(p) OVER w AS p0, lag(size) OVER w AS s1 FROM s WHERE lead = 'II' AND beats >= 5 WINDOW w AS (PARTITION BY rec ORDER BY beat)),
pa AS (SELECT t.rec, count(*) AS n, max(beats) AS beats FROM t JOIN m ON m.rec = t.rec AND m.i = t.beat WHERE p AND p0 AND b0 = beat - 1 AND beat < beats - 1 AND abs(size - s1) / greatest(s1, 0.01) > 0.10 AND m.n >= 5 AND m.i >= 1 AND m.rr < 0.85 * mean GROUP BY t.rec),
a0 AS (SELECT rec, lead, size, row_number() OVER (PARTITION BY rec, lead ORDER BY beat) AS pos FROM s WHERE lead IN ('II', 'V1', 'I') AND beats >= 6 AND beat < 20 AND p),
a1 AS (SELECT rec, lead, avg(size) FILTER (pos % 2 = 1) AS a, avg(size) FILTER (pos % 2 = 0) AS b FROM a0 GROUP BY rec, lead HAVING count(*) >= 6),
a2 AS (SELECT rec, lead, round(abs(a - b) / greatest(a, b) * 100, 6) AS percent FROM a1), a3 AS (SELECT * FROM a2 WHERE percent > 10 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY list_position(['II', 'V1', 'I'], lead)) = 1),
w0 AS (SELECT rec, beat, sum(amp) FILTER (lead = 'I') AS one, sum(amp) FILTER (lead = 'aVF') AS foot FROM c WHERE wave = 'P' GROUP BY rec, beat),
w1 AS (SELECT rec, beat, round(degrees(atan2(foot, one)), 6) AS axis FROM w0 WHERE one IS NOT NULL AND foot IS NOT NULL AND (one <> 0 OR foot <> 0) AND beat < 15 AND rec IN (SELECT rec FROM s WHERE lead = 'II' AND beats >= 8)),
w2 AS (SELECT *, abs(axis - lag(axis) OVER (PARTITION BY rec ORDER BY beat)) AS step FROM w1), w3 AS (SELECT rec, max(axis) - min(axis) AS width, count(*) FILTER (step > 20) AS changes, count(*) AS n FROM w2 GROUP BY rec)
SELECT rec, 'atrial_bigeminy' AS rule, round(share, 6) AS measure FROM bg WHERE share >= 0.5
UNION ALL SELECT rec, 'dropped_beats', count(*)::DOUBLE FROM s WHERE lead IN ('II', 'V1') AND p AND NOT q GROUP BY rec
UNION ALL SELECT rec, 'premature_atrial', round(100 * n / beats, 6) FROM pa
UNION ALL SELECT rec, 'sinus_arrest', max(rr) FROM m WHERE n >= 3 AND rr > 2 * mean GROUP BY rec
UNION ALL SELECT rec, 'p_alternans_' || lead, percent FROM a3
UNION ALL SELECT rec, 'wandering_pacemaker', round(width, 6) FROM w3 WHERE n >= 8 AND width > 90 AND changes >= 3""",
    "conduction": """
WITH e AS (SELECT user_id AS rec, CASE WHEN event_type = 'click' THEN 'P' WHEN event_type IN ('view', 'purchase') THEN 'QRS' END AS wave, epoch_us(ts) / 1000 AS t FROM events),
p AS (SELECT rec, t FROM e WHERE wave = 'P'), q AS (SELECT DISTINCT rec, t FROM e WHERE wave = 'QRS'), j AS (SELECT p.rec, q.t - p.t AS pr FROM p ASOF LEFT JOIN q ON p.rec = q.rec AND p.t <= q.t)
SELECT rec, count(*) AS p_waves, count(*) FILTER (pr <= 36000000) AS conducted, count(*) FILTER (coalesce(pr > 36000000, true)) AS dropped, round(avg(pr) FILTER (pr <= 36000000), 3) AS mean_pr FROM j GROUP BY rec""",
}
