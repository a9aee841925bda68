"""Shapes of waves on components made from order lines, thirty orders a recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.functions.signals import LEADS
from sparkwright.operators import beats as B
from sparkwright.operators import shapes as S
from sparkwright.plans.rules import _DENSE, C, dense

FLAGS = [*(n for n in S.SHAPES if n not in ("m_shape", "slurred_s")), "t_dispersion", "high_voltage", "left_axis", "right_axis", "m_shaped_v1", "wide_slurred_s", "broad_delay"]


def wave_shapes(spark, d):
    """Which shapes the leads of each recording have, as one list."""
    out = S.recording_shapes(S.lead_shapes(dense(spark, d)))
    return out.select("rec", F.array_join(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in FLAGS])), ",").alias("shapes"))


def lead_shape_rows(spark, d):
    """How often each lead has each shape."""
    out = S.lead_shapes(dense(spark, d))
    return out.groupBy("lead").agg(*[F.count_if(n).alias(n) for n in S.SHAPES], F.count("t_at").alias("with_t"), F.round(F.avg("width"), 4).alias("width"))


def pseudo_normal(spark, d):
    """Recordings against the same ones with T waves of odd parts turned and halved."""
    now = dense(spark, d)
    return S.pseudo_normal(now, now.withColumn("amp", F.when(F.col("i") % 2 == 1, -F.col("amp") / 2).otherwise(F.col("amp") / 4)))


def beat_shapes(spark, d):
    """T axes that wander and notched P over beats, by recording."""
    parts = dense(spark, d)
    t = B.t_axis_wandering(parts).select("rec", F.lit("t_axis_wandering").alias("rule"), F.round("spread", 4).alias("measure"))
    return t.unionByName(B.p_notching(parts).select("rec", F.lit("p_notching").alias("rule"), F.col("notches").cast("double").alias("measure")))


QUERIES = {f.__name__: f for f in (wave_shapes, lead_shape_rows, pseudo_normal, beat_shapes)}


def _notch(i: int, j: int) -> str:
    lo, hi = f"least(tp[{i}].c, tp[{j}].c)", f"greatest(tp[{i}].c, tp[{j}].c)"
    grid = f"list_min(list_transform(range(0, floor(({hi} - {lo}) / 2)::BIGINT + 1), lambda x: list_sum(list_transform(ts, lambda g: g.a * exp(-0.5::DOUBLE * pow(({lo} + x * 2 - g.c) / greatest(1, g.s), 2))))))"
    big = f"greatest(abs(tp[{i}].a), abs(tp[{j}].a))"
    return f"(len(tp) >= {j} AND tp[{i}].a * tp[{j}].a > 0 AND least(abs(tp[{i}].a), abs(tp[{j}].a)) >= 0.10 AND {hi} - {lo} >= 40 AND 1 - abs({grid}) / {big} >= 0.30)"


_LEADS = f"""WITH {C}, {_DENSE}, g0 AS (SELECT rec, lead, list_sort(list({{'c': center, 'a': amp, 's': sigma}}) FILTER (wave = 'T')) AS ts, list_sort(list({{'c': center, 'a': amp, 's': sigma}}) FILTER (wave = 'QRS')) AS qs FROM dn GROUP BY rec, lead),
g AS (SELECT *, list_sort(list_transform(ts, lambda g: {{'z': -abs(g.a), 'c': g.c, 'a': g.a, 's': g.s}})) AS tp, list_filter(qs, lambda g: g.a > 0.1) AS hi, list_filter(qs, lambda g: g.a < -0.05) AS lo, list_transform(list_filter(qs, lambda g: g.a > 0), lambda g: g.c) AS up FROM g0),
ls AS (SELECT rec, lead, coalesce({_notch(1, 2)} OR {_notch(1, 3)} OR {_notch(2, 3)}, false) AS t_notched,
 coalesce(len(tp) >= 2 AND least(-tp[1].z, -tp[2].z) >= 0.12 AND abs(tp[1].c - tp[2].c) >= 50, false) AS t_split,
 coalesce(len(tp) >= 2 AND greatest(-tp[1].z, -tp[2].z) >= 0.12 AND abs(tp[2].z - tp[1].z) < 0.03 AND tp[1].s >= 50 AND tp[2].s >= 50, false) AS t_plateau,
 coalesce(len(ts) >= 2 AND ts[-1].c - ts[1].c > 100 AND abs(ts[-1].a) / greatest(1e-9, abs(ts[1].a)) < 0.4, false) AS t_u_on_t,
 coalesce(len(hi) >= 2 AND len(lo) >= 1 AND hi[1].c < lo[1].c AND lo[1].c < hi[-1].c, false) AS rsr_pattern,
 coalesce(len(list_filter(qs, lambda g: abs(g.a) > 0.05 AND abs(g.a) < 0.2)) >= 3, false) AS splintered, coalesce(len(list_filter(qs, lambda g: g.a < -0.3)) > 0, false) AS prominent_s,
 coalesce(len(list_filter(range(2, len(up) + 1), lambda k: up[k] - up[k - 1] BETWEEN 20 AND 60)) > 0, false) AS m_shape, coalesce(len(list_filter(qs, lambda g: g.a < -0.2 AND 2 * g.s >= 40)) > 0, false) AS slurred_s,
 tp[1].c AS t_at, list_max(list_transform(qs, lambda g: g.c + 2 * g.s)) - list_min(list_transform(qs, lambda g: g.c - 2 * g.s)) AS width, list_sum(list_transform(qs, lambda g: g.a)) AS net, list_max(list_transform(qs, lambda g: g.a)) AS r, list_min(list_transform(qs, lambda g: g.a)) AS s FROM g)"""


def _quorum(name: str) -> str:
    least, own, near = S.SHAPES[name]
    cond = f"{name} AND lead IN ({', '.join(repr(x) for x in own)})"
    hits = f"list(DISTINCT list_position({LEADS!r}, lead)) FILTER ({cond})"
    return f"coalesce(len(list_filter({hits}, lambda p: list_contains({hits}, p + 1))) > 0, false)" if near else f"count(*) FILTER ({cond}) >= {least}"


_FLAG_SQL = {n: n for n in S.SHAPES if n not in ("m_shape", "slurred_s")} | {
    "t_dispersion": "t_n >= 6 AND round(t_sd, 6) > 50", "high_voltage": "round(greatest(-coalesce(s1, 0), 0) + greatest(coalesce(r5, 0), coalesce(r6, 0), 0), 6) > 3.5", "left_axis": "coalesce(axis < -30, false)", "right_axis": "coalesce(axis > 90, false)",
    "m_shaped_v1": "m_shape AND wide >= 110", "wide_slurred_s": "slurred_s AND wide >= 110", "broad_delay": "wide >= 120 AND NOT m_shape AND NOT slurred_s",
}
ORACLES = {
    "lead_shape_rows": _LEADS + " SELECT lead, " + ", ".join(f"count(*) FILTER ({n}) AS {n}" for n in S.SHAPES) + ", count(t_at) AS with_t, round(avg(width), 4) AS width FROM ls GROUP BY lead",
    "wave_shapes": _LEADS.replace("ls AS (", "ls AS MATERIALIZED (", 1) + f", f AS (SELECT rec, {', '.join(f'{_quorum(n)} AS {n}' for n in S.SHAPES)}, count(t_at) AS t_n, stddev_pop(t_at) AS t_sd, max(net) FILTER (lead = 'I') AS one, max(net) FILTER (lead = 'aVF') AS foot, max(s) FILTER (lead = 'V1') AS s1, max(r) FILTER (lead = 'V5') AS r5, max(r) FILTER (lead = 'V6') AS r6, coalesce(max(width) FILTER (lead IN ('V1', 'I', 'V6')), 0) AS wide FROM ls GROUP BY rec), a AS (SELECT *, CASE WHEN one <> 0 OR foot <> 0 THEN degrees(atan2(foot, one)) END AS axis FROM f) SELECT rec, concat_ws(',', {', '.join(f'''CASE WHEN {_FLAG_SQL[n]} THEN '{n}' END''' for n in FLAGS)}) AS shapes FROM a",
    "pseudo_normal": f"WITH {C}, {_DENSE}, b AS (SELECT rec, lead, amp, CASE WHEN i % 2 = 1 THEN -amp / 2 ELSE amp / 4 END AS was FROM dn WHERE wave = 'T' AND lead IN ('V1', 'V2', 'V3')), s AS (SELECT rec, lead, round(coalesce(sum(amp) FILTER (amp > 0), 0), 9) AS nu, round(coalesce(sum(-amp) FILTER (amp < 0), 0), 9) AS nd, round(max(abs(amp)), 9) AS np, round(coalesce(sum(was) FILTER (was > 0), 0), 9) AS wu, round(coalesce(sum(-was) FILTER (was < 0), 0), 9) AS wd, round(max(abs(was)), 9) AS wp FROM b GROUP BY rec, lead) SELECT rec, count(*) AS leads FROM s WHERE wd > wu AND nu > nd AND round(np - wp, 9) >= 0.15 GROUP BY rec HAVING count(*) >= 2",
    "beat_shapes": f"WITH {C}, {_DENSE}, t AS (SELECT rec, beat, sum(amp) FILTER (lead = 'I') AS one, sum(amp) FILTER (lead = 'aVF') AS foot FROM dn WHERE wave = 'T' AND beat BETWEEN 0 AND 19 GROUP BY rec, beat), w AS (SELECT rec, round(stddev_pop(degrees(atan2(foot, one))), 6) AS spread FROM t WHERE one IS NOT NULL AND foot IS NOT NULL GROUP BY rec HAVING count(*) >= 5), p AS (SELECT rec, lead, beat, center - lag(center) OVER o AS gap, amp * lag(amp) OVER o > 0 AS same FROM dn WHERE wave = 'P' AND lead IN ('II', 'V1', 'I') WINDOW o AS (PARTITION BY rec, lead, beat ORDER BY center, amp)), q AS (SELECT rec, lead, count(DISTINCT beat) AS n FROM p WHERE same AND gap BETWEEN 40 AND 120 GROUP BY rec, lead HAVING count(DISTINCT beat) >= 3) SELECT rec, 't_axis_wandering' AS rule, round(spread, 4) AS measure FROM w WHERE spread > 45 UNION ALL SELECT rec, 'p_notching', sum(n)::DOUBLE FROM q GROUP BY rec",
}
