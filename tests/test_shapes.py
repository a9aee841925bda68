"""Shapes of waves by hand, each beside one that just misses it."""

import math

from sparkwright.operators import beats as B
from sparkwright.operators import shapes as S

SCHEMA = "rec int, lead string, wave string, amp double, center double, sigma double"


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["rec"]: {k for k, v in r.asDict().items() if v is True} for r in S.recording_shapes(S.lead_shapes(df)).collect()}


def both(rec, leads, *waves):
    return [(rec, lead, *w) for lead in leads for w in waves]


def test_t_shapes_by_hand(spark):
    near = ("V2", "V3")
    t = lambda amp, center, sigma: ("T", amp, center, sigma)
    rows = [
        *both(1, near, t(0.3, 200.0, 10.0), t(0.2, 260.0, 10.0)),  # the sum falls to near zero: notched, split
        *both(2, near, t(0.3, 200.0, 40.0), t(0.2, 245.0, 40.0)),  # no valley, 45 ms apart
        *both(3, ("V2", "V5"), t(0.3, 200.0, 10.0), t(0.2, 260.0, 10.0)),  # no neighbours
        *both(4, near, t(0.3, 200.0, 10.0), t(0.11, 260.0, 10.0)),  # notched, but one lobe below 0.12
        *both(5, near, t(0.3, 200.0, 10.0), t(-0.2, 260.0, 10.0)),  # signs differ: split only
        *both(6, near, t(0.15, 200.0, 50.0), t(0.13, 230.0, 50.0)),
        *both(7, near, t(0.15, 200.0, 50.0), t(0.12, 230.0, 50.0)),  # 0.03 apart
        *both(8, near, t(0.3, 200.0, 20.0), t(0.11, 301.0, 20.0)),
        *both(9, near, t(0.3, 200.0, 20.0), t(0.12, 300.0, 20.0)),  # 100 ms, and 0.4
        *[(10, lead, "T", 0.2, 200.0 + 110 * (k % 2), 20.0) for k, lead in enumerate(("I", "II", "V1", "V2", "V3", "V4"))],  # deviation 55
        *[(11, lead, "T", 0.2, 200.0 + 110 * (k % 2), 20.0) for k, lead in enumerate(("I", "II", "V1", "V2", "V3"))],  # five leads
    ]
    got = found(spark, rows)
    has = lambda name: {k for k, v in got.items() if name in v}
    assert has("t_notched") == {1, 4, 8, 9} and has("t_split") == {1, 5, 9} and has("t_plateau") == {6} and has("t_u_on_t") == {8} and has("t_dispersion") == {10}


def test_qrs_shapes_by_hand(spark):
    q = lambda amp, center, sigma=8.0: ("QRS", amp, center, sigma)
    rows = [
        *both(1, ("V1",), q(0.3, -10.0), q(-0.2, 10.0), q(0.2, 30.0)),
        *both(2, ("V1",), q(-0.2, -20.0), q(0.3, -10.0), q(0.2, 30.0)),  # S before both R
        *both(3, ("V3",), q(0.3, -10.0), q(-0.2, 10.0), q(0.2, 30.0)),  # not V1 or V2
        *both(4, ("I", "V6"), q(0.06, -10.0), q(-0.1, 10.0), q(0.19, 30.0)),
        *both(5, ("I", "V6"), q(0.05, -10.0), q(-0.1, 10.0), q(0.2, 30.0)),  # bounds do not count
        *both(6, ("I", "aVL"), q(-0.31, 10.0)), *both(7, ("I", "V1"), q(-0.31, 10.0)),
        *both(8, ("V1",), q(-2.0, 10.0)), *both(8, ("V6",), q(1.6, 0.0)), *both(9, ("V1",), q(-2.0, 10.0)), *both(9, ("V6",), q(1.5, 0.0)),
        *both(10, ("I",), q(1.0, 0.0)), *both(10, ("aVF",), q(-0.6, 0.0)), *both(11, ("I",), q(-0.1, 0.0)), *both(11, ("aVF",), q(1.0, 0.0)), *both(12, ("I",), q(1.0, 0.0)), *both(12, ("aVF",), q(0.0, 0.0)),
        *both(13, ("V1",), q(0.5, -20.0, 20.0), q(0.5, 20.0, 20.0)),  # 40 apart, 120 wide
        *both(14, ("V1",), q(0.5, -5.0, 25.0), q(0.5, 5.0, 25.0)),  # 10 apart, 110 wide
        *both(15, ("V6",), q(0.5, -40.0, 8.0), q(-0.3, 20.0, 20.0)),  # a slurred S, 116 wide
        *both(16, ("V1",), q(0.5, -30.0, 20.0), q(-0.1, 30.0, 20.0)),  # 140 wide, neither
    ]
    got = found(spark, rows)
    has = lambda name: {k for k, v in got.items() if name in v}
    assert has("rsr_pattern") == {1} and has("splintered") == {4} and has("prominent_s") == {6} and has("high_voltage") == {8}
    assert has("left_axis") == {10} and has("right_axis") == {11}
    assert has("m_shaped_v1") == {13} and has("wide_slurred_s") == {15} and has("broad_delay") == {16}


def test_pseudo_normal_by_hand(spark):
    rows = lambda *of: spark.createDataFrame([(r, lead, "T", a, 300.0, 40.0) for r, lead, a in of], SCHEMA)
    before = rows((1, "V1", -0.1), (1, "V2", -0.2), (2, "V1", -0.1), (2, "V2", -0.2), (3, "V1", 0.1), (3, "V2", -0.1))
    now = rows((1, "V1", 0.25), (1, "V2", 0.4), (2, "V1", 0.25), (2, "V2", 0.3), (3, "V1", 0.5), (3, "V2", 0.5), (4, "V1", 0.9))
    assert [(r["rec"], r["leads"]) for r in S.pseudo_normal(now, before).collect()] == [(1, 2)]


def test_beat_shapes_by_hand(spark):
    schema = "rec int, lead string, beat int, wave string, amp double, center double, sigma double"
    rows = []
    for rec, angles in ((1, [0, 100, 0, 100, 0]), (2, [0, 80, 0, 80, 0]), (3, [0, 100, 0, 100])):
        for b, g in enumerate(angles):
            rows += [(rec, "I", b, "T", math.cos(math.radians(g)), 0.0, 1.0), (rec, "aVF", b, "T", math.sin(math.radians(g)), 0.0, 1.0)]
    for rec, lead, gap, second, beats in ((4, "II", 40.0, 0.1, 3), (5, "II", 39.0, 0.1, 3), (6, "V1", 60.0, -0.1, 3), (7, "I", 60.0, 0.1, 2), (8, "V5", 60.0, 0.1, 3)):
        for b in range(beats):
            rows += [(rec, lead, b, "P", 0.1, -160.0, 9.0), (rec, lead, b, "P", second, -160.0 + gap, 9.0)]
    df = spark.createDataFrame(rows, schema)
    assert [r["rec"] for r in B.t_axis_wandering(df).collect()] == [1]
    assert [(r["rec"], r["notches"]) for r in B.p_notching(df).collect()] == [(4, 3)]
