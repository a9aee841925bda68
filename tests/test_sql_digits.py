"""Results that hang on the last digit of a quantile, a share or an angle are DuckDB's."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkwright.operators import components as C
from sparkwright.operators import rules as U
from sparkwright.operators import sequences as Q
from sparkwright.operators import shapes as S
from sparkwright.operators.ordering import interpolated

COMPONENTS = "rec long, wave string, amp double, sigma double"


def test_component_filter_interpolates_equal_sizes(spark):
    sizes = [5 / 25 - 1, 45 / 25 - 1, 49 / 25 - 1]  # a tenth, a tenth, 0.12: 1.2 times the quantile is above 0.12 by a digit
    rows = spark.createDataFrame([(1, "P", v / 8, 10.0) for v in sizes] + [(2, "QRS", 1.0, 10.0), (3, "P", 0.1, 20.0), (None, "P", 0.1, 20.0)], COMPONENTS)
    got = {r["rec"]: (r["kept"], round(r["area"], 6), r["top"], r["state"]) for r in U.atrial_energy(rows).collect()}
    none = (0, 0.0, 0.0, "AF_LIKELY")
    assert got == {1: none, 2: none, 3: none, None: none}


def test_integer_ratios_round_as_sql(spark):
    rows = spark.createDataFrame([(1, i, 1000.0 if i < 323 else 1250.0) for i in range(640)], "key long, i long, rr double")
    assert Q.ratio_shares(rows).select("r1", "r1_5", "r2").first()[:] == (0.504687, 0.0, 0.0)  # 323 of 640; its decimals alone would give 0.504688


def test_quantiles_are_those_of_duckdb(spark):
    rng = np.random.default_rng(4)
    data = [(g, float(v)) for g in range(400) for v in rng.integers(1, 60, rng.integers(1, 12)) / 25 / 8] + [(400, 0.075), (400, 0.07500000000000001), (400, 0.09), (400, 0.115)]
    theirs = duckdb.connect().execute("SELECT g, quantile_cont(x, 0.1) FROM (SELECT unnest(?::BIGINT[]) AS g, unnest(?::DOUBLE[]) AS x) GROUP BY g", [[g for g, _ in data], [x for _, x in data]]).fetchall()
    ours = interpolated(spark.createDataFrame(data, "g long, x double"), "x", 0.1, ["g"], "q").groupBy("g").agg(F.max("q")).collect()
    assert {g: q for g, q in ours} == dict(theirs)


def test_an_axis_of_ninety_degrees_is_not_right(spark):
    columns = "rec long, lead string, wave string, amp double, center double, sigma double"
    almost = [(1, "I", "QRS", 21 / 25 - 1, 108.0, 5.0), (1, "I", "QRS", 29 / 25 - 1, 141.0, 44.0), (1, "aVF", "QRS", 2.32, 0.0, 10.0)]  # the sum of I is -1.1e-16
    rows = [*almost, *[(rec, lead, "QRS", a, 0.0, 10.0) for rec, one, foot in ((2, -1e-12, 2.0), (3, -1.0, 0.0), (4, 0.0, 1.0), (5, -1.0, -1.0), (6, 1.0, -2.0)) for lead, a in (("I", one), ("aVF", foot))]]
    assert rows[0][3] + rows[1][3] == -1.1102230246251565e-16
    got = S.recording_shapes(S.lead_shapes(spark.createDataFrame(rows, columns))).collect()
    assert {r["rec"]: (r["left_axis"], r["right_axis"]) for r in got} == {1: (False, False), 2: (False, True), 3: (False, True), 4: (False, False), 5: (True, False), 6: (True, False)}


def test_named_waves_take_the_narrowest_of_equal_bells(spark):
    columns = "id long, center double, sigma double, amp double, angle double"
    trace = [0.1] * 79 + [9.0]  # only a wide bell reaches the last sample, at 411 ms
    own = spark.createDataFrame([(k, 800.0, -300.0, 9.0, trace, trace) for k in (1, 2, 3)] + [(4, 800.0, -300.0, 0.0, trace, trace), (5, 800.0, -300.0, 9.0, [], [])], "id long, rr double, start double, step double, vx array<double>, vy array<double>")
    wide, narrow = (300.0, 60.0, 0.5, 0.1), (300.0, 10.0, 0.5, 0.1)
    rows = [(1, *wide), (1, *narrow), (2, *narrow), (2, *wide), (3, *wide), (3, float("nan"), 10.0, 0.5, 0.1), (3, 300.0, float("inf"), 0.5, 0.1), (4, *wide), (5, *wide)]
    got = {(r["id"], r["wave"]): r["amp"] for r in C.name_waves(spark.createDataFrame(rows, columns).repartition(4), own).collect()}
    assert got == {(1, "T"): 0.141, (2, "T"): 0.141, (3, "T"): 12.728}
