"""Streaming forms of the sequence operators. These are extensions: the batch operators define the results."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_counts(events: DataFrame, size: str = "10 seconds", step: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", size, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def pauses(events: DataFrame, least_ms: int = 2000, late: str = "10 minutes") -> DataFrame:
    """(user_id, ts, gap_ms) of events that come more than least_ms after the user's event before, across batches.

    The state of a user is one time; it expires when the watermark passes an hour beyond it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        times = rows["ts"].tolist()
        before = [last, *times[:-1]]
        out = [(key[0], t, (t - b) / pd.Timedelta(milliseconds=1)) for b, t in zip(before, times, strict=True) if b is not None and t - b > pd.Timedelta(milliseconds=least_ms)]
        newest = max([t for t in (last, times[-1]) if t is not None])
        state.update((int(newest.value // 1000),))
        state.setTimeoutTimestamp(int(newest.value // 1_000_000) + 3_600_000)
        yield pd.DataFrame(out, columns=["user_id", "ts", "gap_ms"])

    keyed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(run, "user_id long, ts timestamp, gap_ms double", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def triplets_in(times: list[int], memory: int = 20, least: int = 5, short: float = 0.8, long: float = 1.2) -> list[int]:
    """Times (in order) at which a short, a long and a short interval end, against the median of up to `memory` intervals before them (`least` or
    more are needed)."""
    gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
    found = []
    for k in range(2, len(gaps)):
        before = gaps[max(0, k - 2 - memory) : k - 2]
        if len(before) >= least:
            m = median(before)
            if gaps[k - 2] < short * m and gaps[k - 1] > long * m and gaps[k] < short * m:
                found.append(times[k + 1])
    return found


class _Triplets(StatefulProcessor):
    """Per key: the times that the watermark has not passed yet (a map), and the last ones that it has (a value). A timer stands at the
    first pending time; when the watermark passes it, what is final is put in order and looked through."""

    memory = 20

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "us long", "seen boolean")
        self.recent = handle.getValueState("recent", "us array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        final = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for frame in rows:
            for us in frame["us"].tolist():
                if us > final:  # later than that it was late
                    self.pending.updateValue((us,), (True,))
                    first = us if first is None else min(first, us)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        final = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(us for (us,) in self.pending.keys())
        ready = [us for us in waiting if us <= final]
        for us in ready:
            self.pending.removeKey((us,))
        if len(ready) < len(waiting):
            self.handle.registerTimer(waiting[len(ready)] // 1000 + 1)
        if not ready:
            return iter([])
        old = list(self.recent.get()[0]) if self.recent.exists() else []
        times = old + ready
        found = [us for us in triplets_in(times, self.memory) if us > (old[-1] if old else -1)]
        self.recent.update((times[-(self.memory + 3) :],))
        return iter([pd.DataFrame({"user_id": [key[0]] * len(found), "us": found})]) if found else iter([])

    def close(self) -> None:
        pass


def triplets(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(user_id, us) of the events that end a short-long-short triplet of their user's intervals, in microseconds, whatever the order in
    which events arrive within `late`; events of one time count once, later ones are dropped. Needs the RocksDB state store."""
    keyed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return keyed.groupBy("user_id").transformWithStateInPandas(_Triplets(), "user_id long, us long", "append", "EventTime")


class _Thoughts:
    """Splits chunks of one text at think tags that may be cut between chunks; its state is what may be a part of a tag, and where it is."""

    def __init__(self, held: str = "", inside: bool = False):
        self.held, self.inside = held, inside

    def feed(self, chunk: str, last: bool = False) -> tuple[str, str]:
        text, out = self.held + chunk, ["", ""]
        while True:
            tag = "</think>" if self.inside else "<think>"
            before, found, rest = text.partition(tag)
            if found:
                out[self.inside] += before
                self.inside, text = not self.inside, rest
                continue
            keep = 0 if last else next((n for n in range(min(len(text), len(tag) - 1), 0, -1) if text.endswith(tag[:n])), 0)
            out[self.inside] += text[: len(text) - keep]
            self.held = text[len(text) - keep :]
            return out[0], out[1]


def thoughts(chunks: DataFrame) -> DataFrame:
    """(key, seq, answer, thought) of a stream of (key, seq, text, last): what each chunk lets out, in order of seq within a batch. What may be
    a part of a tag is held back until the next chunk; `last` lets the rest out and ends the key's state. Chunks of a key arrive in order of their batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        split = _Thoughts(*state.get) if state.exists else _Thoughts()
        rows = pd.concat(list(frames)).sort_values("seq")
        out, ended = [], False
        for r in rows.itertuples():
            out.append((key[0], r.seq, *split.feed(r.text or "", bool(r.last))))
            ended = ended or bool(r.last)
        if ended:
            state.remove()
        else:
            state.update((split.held, split.inside))
        yield pd.DataFrame(out, columns=["key", "seq", "answer", "thought"])

    return chunks.groupBy("key").applyInPandasWithState(run, "key long, seq long, answer string, thought string", "held string, inside boolean", "append", GroupStateTimeout.NoTimeout)
