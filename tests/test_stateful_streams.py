"""Stateful streams against plain Python on the same events, which arrive out of order and in several files."""

import random

import pandas as pd

from sparkwright.operators import governance as G
from sparkwright.streaming import events as E


def test_triplets_of_a_series_by_hand():
    steady = [100 * k for k in range(8)]  # seven intervals of 100
    assert E.triplets_in([*steady, 770, 900, 970]) == [970]
    assert E.triplets_in([*steady, 780, 910, 980]) == []  # 80 is not short
    assert E.triplets_in([*steady[:5], 470, 600, 670]) == []  # four intervals before


def test_triplets_of_a_stream(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = random.Random(5)
        rows, want = [], []
        for user in range(3):
            at, times = 1_700_000_000_000_000 + user, []
            for k in range(60):
                at += 60_000_000 if k % 9 in (6, 8) else 140_000_000 if k % 9 == 7 else 100_000_000 + rng.randrange(1000)
                times.append(at)
            want += [(user, us) for us in E.triplets_in(times)]
            rows += [(user, us) for us in times]
        rows.sort(key=lambda r: r[1] + rng.randrange(200_000_000))  # up to 200 s out of order
        end = max(us for _, us in rows)
        for k in range(0, len(rows), 30):
            part = pd.DataFrame(rows[k : k + 30] + ([(99, end + 10**10)] if k + 30 >= len(rows) else []), columns=["user_id", "us"])
            part["ts"] = pd.to_datetime(part["us"], unit="us", utc=True)
            spark.createDataFrame(part[["user_id", "ts"]], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = E.event_stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp", 1)
        q = E.triplets(stream, "400 seconds").writeStream.format("memory").queryName("triplets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        got = sorted((r["user_id"], r["us"]) for r in spark.table("triplets").collect())
        assert got == sorted(want) and len(want) > 9
    finally:
        spark.conf.unset(provider)


def test_thoughts_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for key in range(12):
        text = "".join(rng.choice(["<think>", "</think>", "<thi", "nk>", "a", "b ", "<"]) for _ in range(12)) + "."
        cuts = sorted(rng.sample(range(1, len(text)), min(6, len(text) - 1)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        rows += [(key, k, p, k == len(pieces) - 1) for k, p in enumerate(pieces)]
    batch = spark.createDataFrame(rows, "key long, seq long, text string, last boolean")
    whole = lambda rs: {k: tuple("".join(r[c] for r in sorted(rs, key=lambda r: r["seq"]) if r["key"] == k) for c in ("answer", "thought")) for k in {r["key"] for r in rs}}
    for k in range(0, 7, 3):
        batch.where(f"seq >= {k} and seq < {k + 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = E.event_stream(spark, str(tmp_path / "in"), "key long, seq long, text string, last boolean", 1)
    q = E.thoughts(stream).writeStream.format("memory").queryName("thoughts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert whole(spark.table("thoughts").collect()) == whole(G.split_think_chunks(batch).collect())
