"""Kernels are spread over tasks however few bytes their rows have."""

import math

from pyspark.sql import functions as F

from sparkwright.operators import kernels as K
from sparkwright.plans import cases as N
from sparkwright.plans import components as C
from sparkwright.plans import kernels as S
from sparkwright.plans.sequences import rr


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_user_recordings_are_spread_and_as_defined(spark, sf):
    made = C.user_recordings(spark, sf)
    assert tasks(made) > 1
    row = made.orderBy("id").first()
    beats = rr(spark, sf).where((F.col("key") == row["id"] // 1_000_000) & (F.floor(F.col("i") / 12) == row["id"] % 1_000_000)).orderBy("i").collect()
    at, want = 400.0, []
    for b in beats:
        k = b["i"] % 12
        at += 800 - 260 * (k % 6 == 4) + 240 * (k % 6 == 5) + b["rr"] % 20
        want.append((at, 60 if k % 6 == 4 else 25))
    x = row["leads"][0]
    assert len(x) == int(at / 4 + 150) + 1
    assert all(abs(v - sum(math.exp(-(((s * 4 - a) / w) ** 2)) for a, w in want if abs(s * 4 - a) <= 200)) < 1e-12 for s, v in enumerate(x))


def test_interval_mixtures_are_spread(spark, sf):
    assert tasks(K.interval_mixtures(rr(spark, sf))) > 1


def test_waves_of_twelve_leads_are_made_once(spark, sf):
    plan = S.recording_features(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    made = next(x for x in plan.splitlines() if "AS leads" in x)
    assert "zip_with" in made and "EXP" not in made and "SIN" not in made


def test_notches_are_sought_once_for_equal_pairs(spark, sf):
    plan = N.notch_rule(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Aggregate" in x for x in plan) == 2
