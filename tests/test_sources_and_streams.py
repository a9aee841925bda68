"""Round trips of sources and sinks, signal kernels on constructed signals, and streams against their batch forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.functions import signals as K
from sparkwright.sources import files as S
from sparkwright.streaming import events as E


def test_manifest_and_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text("recording_id,path\na,1\n ,2\na,3\nb,4\n")
    assert {tuple(r) for r in S.read_manifest(spark, str(tmp_path / "m.csv")).collect()} == {("a", "3"), ("b", "4")}
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert S.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").where("a is not null").count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"p": ["x", "y"], "q": []}))
    assert {tuple(r) for r in S.read_map_of_lists(spark, str(tmp_path / "s.json")).collect()} == {("p", 0, "x"), ("p", 1, "y")}


def test_npy(spark, tmp_path):
    m = np.arange(12.0).reshape(6, 2)
    np.save(tmp_path / "m.npy", m)
    spark.dataSource.register(S.NpySource)
    df = spark.read.format("npy").option("rowsPerPartition", 4).load(str(tmp_path / "m.npy"))
    assert [r["values"] for r in df.orderBy("idx").collect()] == m.tolist() and df.rdd.getNumPartitions() == 2


def test_recordings(spark, tmp_path):
    samples = np.stack([np.arange(100), -np.arange(100)], axis=1).astype("<i2")
    (tmp_path / "r1.mat").write_bytes(b"\0" * 24 + samples.tobytes())
    head = "r1 2 500 100\nr1.mat 16+24 1000(0)/mV 16 0 0 0 0 I\nr1.mat 16+24 1000(0)/mV 16 0 0 0 0 avr\n#Age: 63\n#Sex: Male\n#Dx: 426783006,111\n"
    (tmp_path / "r1.hea").write_text(head)
    (tmp_path / "r2.hea").write_text(head)
    assert [r["stem"] for r in S.discover_recordings(spark, str(tmp_path)).collect()] == ["r1"]
    r = S.read_recordings(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0]["fs"] == 500 and r[0]["leads"][0][5] == 0.005 and r[0]["leads"][3][5] == -0.005 and r[0]["leads"][1] == []
    h = S.header_comments(spark.createDataFrame([(head,)], "text string")).first()
    assert (h["age"], h["sex"], h["codes"]) == (63.0, "male", ["426783006", "111"])
    assert spark.createDataFrame([(head,)], "t string").select(S.referenced_files(F.col("t"))).first()[0] == ["r1.mat"]
    assert spark.createDataFrame([("x 2020-03-01 y",)], "t string").select(S.repair_date(F.col("t"))).first()[0] == "x 01/03/2020 y"


def test_recordings_of_one_name_in_two_folders(spark, tmp_path):
    for k, folder in enumerate(("a", "b")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r1.mat").write_bytes(np.full((10, 1), 100 * (k + 1), "<i2").tobytes())
        (tmp_path / folder / "r1.hea").write_text(f"r1 1 {500 + k} 10\nr1.mat 16 1000(0)/mV 16 0 0 0 0 I\n")
    got = {r["base"].rsplit("/", 2)[1]: (r["fs"], r["leads"][0][0]) for r in S.read_recordings(spark, str(tmp_path)).collect()}
    assert got == {"a": (500.0, 0.1), "b": (501.0, 0.2)}
    assert S.discover_recordings(spark, str(tmp_path)).count() == 2


def test_matrices_and_documents(spark, tmp_path):
    m = np.arange(12.0).reshape(6, 2)
    np.save(tmp_path / "m.npy", m)
    rows = S.read_matrices(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["values"] for r in rows] == m.tolist() and rows[0]["path"].endswith("m.npy")
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"p": ["x"]}))
    first = S.cached_document(spark, str(path))
    assert S.cached_document(spark, str(path)) is first
    path.write_text(json.dumps({"p": ["x", "y"]}))
    import os

    os.utime(path, (1, 1))
    assert S.cached_document(spark, str(path)).count() == 2


def test_shifted():
    assert np.nan_to_num(K.shifted(np.array([1.0, 2, 3]), 1), nan=-1).tolist() == [-1, 1, 2]
    assert np.nan_to_num(K.shifted(np.array([1.0, 2, 3]), -2), nan=-1).tolist() == [3, -1, -1]
    beat = np.exp(-(((np.arange(60) - 30) / 4.0) ** 2))
    grid = K.aligned([beat, beat, np.roll(beat, 3)], [30, 30, 30])
    assert [int(np.nanargmax(r)) for r in grid] == [30, 30, 30] and np.isnan(grid[2]).any()


def test_lead_table(spark, tmp_path):
    names = [x.upper() for x in reversed(K.LEADS)]
    (tmp_path / "l.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(12))) + "\n")
    assert S.read_lead_table(spark, str(tmp_path / "l.csv")).first()["V6"] == 0.0
    (tmp_path / "bad.csv").write_text("I,II\n1,2\n")
    with pytest.raises(ValueError, match="missing leads"):
        S.read_lead_table(spark, str(tmp_path / "bad.csv"))


def test_upload():
    assert S.check_upload([("a.csv", 10)]) == []
    assert len(S.check_upload([("a.exe", 1), ("x/b.csv", 1), ("b.csv", 1)])) == 2
    assert S.check_upload([(f"{i}.csv", 1) for i in range(5)]) == ["more than 4 files"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (2, 3, 4):
        S.swap_json(spark.range(n), path)
    assert spark.read.json(path).count() == 4 and spark.read.json(f"{path}.bak").count() == 2
    S.append_json(spark.range(1), path)
    assert spark.read.json(path).count() == 5
    points = spark.createDataFrame([(1, ["a", "b"], "x,y")], "id int, labels array<string>, n string")
    S.export_points(points, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).where("value like '1%'").first()[0] == '1,a;b,"x,y"'
    assert json.loads(S.write_report(points, str(tmp_path / "r")))["labels"] == ["a", "b"]
    S.write_manifest(spark.range(2), str(tmp_path / "m" / "pca"))
    assert S.variants(spark, str(tmp_path / "m")) == ["pca"] and S.variant_path("b", "tsne") == "b/tsne_p30"
    with pytest.raises(ValueError, match="unknown method"):
        S.variant_path("b", "other")


def test_kernels():
    t = np.arange(5000) / 500
    beats = sum(np.exp(-(((t - c) / 0.012) ** 2)) for c in np.arange(0.5, 10, 0.8))
    x = np.stack([beats, 0.5 * beats]) + 0.2 * np.sin(2 * np.pi * 0.05 * t)
    y, clean = K.preprocess(x)
    peaks = K.r_peaks(K.energy(y), 500)
    assert clean and np.allclose(np.diff(peaks), 400, atol=2) and len(peaks) == 12
    assert len(K.average_beat(y[0], peaks)) >= 400
    assert np.allclose(K.savgol(t**2), t**2)
    assert np.allclose(K.pchip(np.array([0.0, 1, 2]), np.array([0.0, 1, 2]), np.array([0.5, 1.5])), [0.5, 1.5])
    assert K.local_maxima(np.array([0, 1, 1, 0, 2, 0])).tolist() == [1, 4]
    assert K.spaced_from_right(np.array([0, 5, 9]), 5).tolist() == [0, 9] or K.spaced_from_right(np.array([0, 5, 9]), 5).tolist() == [9]
    assert K.dbscan(np.array([[0.0], [0.1], [0.2], [9.0]]), 0.15).tolist() == [0, 0, 0, -1]
    assert K.beat_clusters(np.array([[0.0], [5.0]] * 10)).tolist() == [0, 1] * 10
    assert K.interval_mixture(np.array([600.0, 605, 595] * 10 + [900.0, 905, 895] * 10))["k"] == 2
    f = np.linspace(0.02, 0.25, 200)
    times = np.cumsum(np.full(60, 0.9))
    assert abs(f[K.lomb_scargle(times, np.sin(2 * np.pi * 0.1 * times), 2 * np.pi * f).argmax()] - 0.1) < 0.01
    assert K.band_rhythm(np.zeros(3), np.full(3, 800.0))["period"] is None
    assert [K.periodic_indices(np.array(a)) for a in ([0, 3, 6], [0, 1, 5], [0, 3, 5], [1])] == ["every_nth", "grouped", "random", "none"]
    parts = K.fit_gaussians(np.arange(100.0), K.gaussian_sum(np.arange(100.0), [(1.0, 30.0, 5.0), (0.6, 70.0, 6.0)]))
    assert np.allclose(sorted(p[1] for p in parts), [30, 70], atol=0.5)
    assert K.extrema(np.sin(np.arange(0, 6.3, 0.1)))[0][1] == pytest.approx(1, abs=1e-2)
    mag, angle = K.plane_projection(np.ones((2, 3)), np.eye(2))
    assert np.allclose(mag, 2**0.5) and np.allclose(angle, 45)
    assert set(K.st_measures(y[0], int(peaks[3]), 500)) >= {"j_level", "st60", "coved"}
    spike = np.zeros(200)
    spike[100] = 1
    assert K.anchored_baseline(spike + 3, np.array([10, 60, 150, 190]), 5).mean() == pytest.approx(3, abs=0.1)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = E.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double", 1)
    q = E.tumbling_counts(stream, late="400 days").writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("tumbling").select("window", "event_type", "n").exceptAll(batch).count() == 0
    assert spark.table("tumbling").count() == batch.count()
    q = E.pauses(stream, 1000, "400 days").writeStream.format("memory").queryName("pauses").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pauses").count() > 0
