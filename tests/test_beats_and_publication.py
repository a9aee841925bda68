"""Rules on beats, chunked tags, nested JSON and file listings by hand and by brute force."""

import json
import random

import pytest

from sparkwright.operators import beats as B
from sparkwright.operators import governance as G


def series(spark, rows):
    return B.p_series(spark.createDataFrame(rows, "rec int, lead string, beat int, wave string, amp double, center double, sigma double"))


def beat_rows(rec, lead, sizes, qrs=True):
    out = [(rec, lead, b, "P", a, 0.0, 10.0) for b, a in enumerate(sizes) if a is not None]
    return out + [(rec, lead, b, "QRS", 1.0, 0.0, 10.0) for b in range(len(sizes)) if qrs is True or b in qrs]


def intervals(spark, of):
    return spark.createDataFrame([(r, i, float(v)) for r, x in of.items() for i, v in enumerate(x)], "rec int, i int, rr double")


def test_atrial_bigeminy_by_hand(spark):
    turns = [1000, 600] * 4  # mean 800: long over 720, short under 680
    s = series(spark, beat_rows(1, "II", [0.1] * 8) + beat_rows(2, "II", [0.1] * 5) + beat_rows(3, "II", [0.1] * 8) + beat_rows(4, "II", [0.1] * 8))
    rr = intervals(spark, {1: turns, 2: turns, 3: [600, 1000] * 4, 4: [1000, 600, 800, 800, 800, 800]})
    got = {r["rec"]: (r["pairs"], r["share"], r["present"]) for r in B.atrial_bigeminy(rr, s).collect()}
    assert got == {1: (4, 1.0, True), 3: (0, 0.0, False), 4: (1, 1 / 3, False)}


def test_dropped_and_premature_beats_by_hand(spark):
    rows = beat_rows(1, "II", [0.1] * 4, qrs={0, 2}) + beat_rows(1, "V1", [0.1, None], qrs=set()) + beat_rows(1, "I", [0.1], qrs=set()) + beat_rows(2, "II", [0.1])
    assert [(r["rec"], r["dropped"]) for r in B.dropped_beats(series(spark, rows)).collect()] == [(1, 3)]
    sizes = [0.10, 0.10, 0.12, 0.12, 0.20, 0.10]
    s = series(spark, beat_rows(1, "II", sizes) + beat_rows(2, "II", [0.1, None, 0.2, 0.1, 0.1, 0.1]) + beat_rows(3, "II", sizes[:4]))
    rr = intervals(spark, {k: [600, 1000, 600, 1000, 600, 600] for k in (1, 2, 3)})  # mean 733: early under 623
    # 1: beat 2 (0.10 to 0.12) and 4 (0.12 to 0.20); beat 5 is the last one. 2: no P before beat 2, none differs at 4. 3: too few beats
    assert [(r["rec"], r["early"], r["share"]) for r in B.premature_atrial(rr, s).collect()] == [(1, 2, 200 / 6)]


def test_arrest_alternans_and_wandering_by_hand(spark):
    got = {r["rec"]: (r["pauses"], r["longest"]) for r in B.sinus_arrest(intervals(spark, {1: [500, 500, 500, 2500], 2: [500, 2000], 3: [1000, 1000, 1900]})).collect()}
    assert got == {1: (1, 2500.0)}
    rows = beat_rows(1, "II", [0.1, 0.1] * 3) + beat_rows(1, "V1", [0.1, 0.12] * 3) + beat_rows(1, "I", [0.1, 0.2] * 3) + beat_rows(2, "II", [0.1, 0.11] * 3) + beat_rows(3, "II", [0.1, 0.2] * 2)
    assert [(r["rec"], r["lead"], r["percent"]) for r in B.p_alternans(series(spark, rows)).collect()] == [(1, "V1", pytest.approx(100 / 6))]
    import math

    wide = [0, 30, 60, 95, 95, 95, 95, 95]
    parts = []
    for rec, angles in ((1, wide), (2, wide[:7]), (3, [0, 95, 95, 0, 0, 0, 0, 0]), (4, [0, 30, 60, 90, 90, 90, 90, 90])):
        for b, g in enumerate(angles):
            parts += [(rec, "I", b, "P", math.cos(math.radians(g)), 0.0, 1.0), (rec, "aVF", b, "P", math.sin(math.radians(g)), 0.0, 1.0), (rec, "II", b, "QRS", 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(parts, "rec int, lead string, beat int, wave string, amp double, center double, sigma double")
    assert [(r["rec"], r["width"], r["changes"]) for r in B.wandering_pacemaker(df, B.p_series(df)).collect()] == [(1, 95.0, 3)]


def test_next_qrs_by_hand(spark):
    rows = [(1, "P", 10.0), (1, "P", 20.0), (1, "QRS", 20.0), (1, "QRS", 900.0), (1, "P", 950.0), (2, "QRS", 5.0), (2, "P", 6.0), (1, "T", 15.0), (1, "P", None)]
    df = spark.createDataFrame(rows, "rec int, wave string, at double")
    assert sorted((r["rec"], r["at"], r["qrs_at"]) for r in B.next_qrs(df).collect()) == [(1, 10.0, 20.0), (1, 20.0, 20.0), (1, 950.0, None), (2, 6.0, None)]
    assert {r["rec"]: (r["conducted"], r["dropped"], r["mean_pr"]) for r in B.conduction(df).collect()} == {1: (2, 1, 5.0), 2: (0, 1, None)}


def plain_split(text):
    answer, thought, inside, at = "", "", False, 0
    while at < len(text):
        tag = "</think>" if inside else "<think>"
        if text.startswith(tag, at):
            inside, at = not inside, at + len(tag)
            continue
        answer, thought = (answer, thought + text[at]) if inside else (answer + text[at], thought)
        at += 1
    return answer, thought


def test_chunked_tags_equal_the_whole_text(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for key in range(150):
        text = "".join(rng.choice(["<think>", "</think>", "<thi", "nk>", "</", "think>", "<", "a", "é ", "\n"]) for _ in range(rng.randint(0, 14)))
        want[key] = plain_split(text)
        at, k = 0, 0
        while at < len(text):
            n = rng.choice([1, 1, 2, 3, 7, 8, 30])
            rows.append((key, k, text[at : at + n], "x"))
            at, k = at + n, k + 1
            if rng.random() < 0.2:
                rows.append((key, k, rng.choice(["", None]), "x"))
                k += 1
    df = spark.createDataFrame(rows, "key int, seq int, text string, state string").repartition(5)
    got = {}
    for r in sorted(G.split_think_chunks(df).collect(), key=lambda r: (r["key"], r["seq"])):
        a, b = got.get(r["key"], ("", ""))
        got[r["key"]] = (a + r["answer"], b + r["thought"])
    assert {k: got.get(k, ("", "")) for k in want} == want
    assert G.split_think_chunks(df.limit(0)).count() == 0


def test_nested_sources_by_hand(spark):
    text = json.dumps({"a": [{"pos_by_source": {"p1": 2, "open": 3, "p2": 4.5, "private": 1}}], "train_sources": ["p1", "open", "p2"], "x": {"y": ["p1", {"z": "p2"}, 7, None, True]}, "neg_by_source": "p1", "sources": {"p1": 1}, "é": 1.0})
    rows = [(1, text, "keep"), (2, None, "k"), (3, '"p1"', "k"), (4, "[]", "k"), (5, '{"pos_by_source":{"p1":"n"}}', "k")]
    out = {r["id"]: r for r in G.generic_json(spark.createDataFrame(rows, "id int, doc string, other string"), "doc", ["p1", "p2"]).collect()}
    assert json.loads(out[1]["doc"]) == {
        "a": [{"pos_by_source": {"open": 3, "private": 7.5}}], "train_sources": ["private", "open"], "x": {"y": ["private", {"z": "private"}, 7, None, True]}, "neg_by_source": "private", "sources": {"p1": 1}, "é": 1.0,
    }
    assert (out[1]["map_hits"], out[1]["list_hits"], out[1]["value_hits"], out[1]["other"]) == (2, 2, 3, "keep")
    assert out[2]["doc"] is None and out[3]["doc"] == '"private"' and out[4]["doc"] == "[]" and json.loads(out[5]["doc"]) == {"pos_by_source": {"private": 0}}


def test_files_are_listed_and_matched(spark, tmp_path):
    for name in ("open/r/1.hea", "open/r/1.mat", "open/r/2.hea", "open/r/3.dat", "open/r/3.hea", "open/r/3.mat", "closed/4.hea", "closed/4.dat", "secret/5.hea", "secret/5.dat", "open/a.b/6.hea", "open/a.b/6.dat"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x" * (10 if name.endswith("hea") else 100 if name.endswith("mat") else 1000))
    files = G.file_listing(spark, str(tmp_path))
    assert files.count() == 12 and "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    paths = {1: "/x/WFDB/open/r/1.hea", 2: "/x/wfdb/open/r/2.hea", 3: "C:\\d\\WFDB\\open\\r\\3", 4: "/WFDB/closed/4.hea", 5: "/WFDB/secret/5.hea", 6: "/WFDB/open/a.b/6.hea", 7: "/elsewhere/7.hea", 8: ""}
    index = spark.createDataFrame(list(paths.items()), "id int, path string")
    records = spark.createDataFrame([(i, "a") for i in range(1, 10)], "id int, source string")
    got = {r["id"]: (r["state"], r["bytes"]) for r in G.resolve_files(records, index, files, "wfdb", {"a": ["open", "secret"]}, ["Secret"]).collect()}
    assert got == {1: ("ok", 110), 2: ("files absent", None), 3: ("ok", 110), 4: ("outside allowlist", None), 5: ("denylisted", None), 6: ("ok", 1010), 7: ("outside", None), 8: ("not in path index", None), 9: ("not in path index", None)}


def test_nested_values_are_normalised_at_any_depth(spark):
    from sparkwright.operators import cases as K

    schema = "id int, a struct<x: double, y: array<struct<z: float, s: string>>>, m map<int, double>, b binary, n bigint, d date"
    inf, nan = float("inf"), float("nan")
    rows = [(1, (1.005, [(2.25, "t"), None, (nan, None)]), {3: inf, 4: 0.126}, bytearray("é".encode()), 9, None), (2, None, None, None, None, None), (3, (nan, []), {}, bytearray(), 0, None)]
    got = [json.loads(r["record"]) for r in K.record_json(spark.createDataFrame(rows, schema)).collect()]
    assert got[0]["a"] == {"x": 1.01, "y": [{"z": 2.25, "s": "t"}, None, {"z": None, "s": None}]} or got[0]["a"]["x"] in (1.0, 1.01)
    assert got[0]["a"]["y"] == [{"z": 2.25, "s": "t"}, None, {"z": None, "s": None}]
    assert got[0]["m"] == {"3": None, "4": 0.13} and got[0]["b"] == "é" and got[0]["n"] == 9
    assert got[1] == {"id": 2, "a": None, "m": None, "b": None, "n": None, "d": None} and got[2]["a"] == {"x": None, "y": []} and got[2]["m"] == {}


def test_affected_records_and_indexes_take_the_last_row(spark):
    from sparkwright.operators import cases as K

    affected = spark.createDataFrame([("c", 1, 10), ("c", 2, 11), ("c", 1, 10)], "cohort string, study int, id int")
    rows = spark.createDataFrame([(10, ["a"], ["p"], 1), (10, ["b"], ["q"], 2), (10, ["z"], ["z"], 0)], "id int, labels array<string>, predictions array<string>, i int")
    reports = spark.createDataFrame([(1, ["x"]), (1, ["y"])], "study int, lines array<string>")
    got = sorted((r["id"], r["labels"], r["predictions"], r["lines"]) for r in K.affected_records(affected, rows, reports).collect())
    assert got == [(10, ["b"], ["q"], ["y"]), (10, ["b"], ["q"], ["y"]), (11, [], [], [])]
    index = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), (None, 9, "n")], "k string, i int, v string")
    assert [tuple(r) for r in K.indexed(index, "k", "i", "v").collect()] == [("a", 3, "y")]
    wide = spark.createDataFrame([(1, None, "x"), (2, None, None)], "id int, extra int, more string")
    assert sorted(tuple(r) for r in K.unexpected_values(wide, ["id"], []).collect()) == [("extra", 2, 0), ("more", 2, 1)]
