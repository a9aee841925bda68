"""Signal kernels on tables: one recording or one key's sequence is one Arrow group, everything around it is columns.

A recording is bounded (two minutes of twelve leads), so a row or a group fits a task whatever the number of recordings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import signals as K


def per_key(rows: DataFrame, schema: str, kernel: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """kernel on the rows (key, i, ...) of each key, in order of i; its result is one row with the key."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"key": group["key"].iloc[0], **kernel(group.sort_values("i"))}])

    return rows.groupBy("key").applyInPandas(run, f"key long, {schema}")


def event_clusters(rows: DataFrame) -> DataFrame:
    """Density clusters of (a, b, c) with eps 0.15 of the mean deviation: their number, noise and the largest."""

    def kernel(g: pd.DataFrame) -> dict:
        x = g[["a", "b", "c"]].to_numpy(float)
        if len(x) < 3:
            return {"clusters": 1, "noise": 0, "largest": len(x)}
        label = K.dbscan(x, 0.15 * x.std(axis=0).mean())
        return {"clusters": len(set(label.tolist())), "noise": int((label < 0).sum()), "largest": int(np.bincount(label + 1).max())}

    return per_key(rows, "clusters int, noise int, largest int", kernel)


def beat_clusters(rows: DataFrame) -> DataFrame:
    def kernel(g: pd.DataFrame) -> dict:
        label = K.beat_clusters(g[["a", "b", "c"]].to_numpy(float))
        change = float(np.mean(label[1:] != label[:-1])) if len(label) > 1 else 0.0
        return {"k": int(label.max()) + 1, "share": float(np.bincount(label).max() / len(label)), "alternation": change}

    return per_key(rows, "k int, share double, alternation double", kernel)


def morphology_clusters(rows: DataFrame, features: list[str], most: int = 3) -> DataFrame:
    """(key, k, dominant, minority, premature) of the beats (key, i, rr, features) of each key: the number of clusters with the best
    silhouette, the share of the largest one, the places of the others' beats, and those of them after a short (0.85 of the
    median) and before a long interval (1.1)."""

    def kernel(g: pd.DataFrame) -> dict:
        label = K.best_clusters(g[features].to_numpy(float), most)
        others = np.flatnonzero(label != np.bincount(label).argmax())
        rr = g["rr"].to_numpy(float)
        median = np.median(rr)
        early = [i for i in others.tolist() if i > 0 and 0 < rr[i - 1] < 0.85 * median and rr[i] > 1.1 * median]
        return {"k": len(np.unique(label)), "dominant": float(np.bincount(label).max() / len(label)), "minority": others.tolist(), "premature": early}

    return per_key(rows, "k int, dominant double, minority array<int>, premature array<int>", kernel)


def interval_clusters(rows: DataFrame) -> DataFrame:
    """(key, k, separation, ratio, cycle) of each key's intervals: the two or three modes that are best apart (one with fewer
    than six intervals), FLT2 or FLT3 where their centers stand as 2:1 or 3:1, BIGEM or TRIGEM where they take turns."""

    def kernel(g: pd.DataFrame) -> dict:
        label, centers, apart = K.interval_modes(g["rr"].to_numpy(float))
        return {"k": len(centers), "separation": apart, "ratio": K.center_ratio(centers), "cycle": K.label_cycle(label)}

    return per_key(rows, "k int, separation double, ratio string, cycle string", kernel)


def interval_mixtures(rows: DataFrame) -> DataFrame:
    def kernel(g: pd.DataFrame) -> dict:
        return K.interval_mixture(g["rr"].to_numpy(float)) if len(g) >= 12 else {"k": 1.0, "low": float(g["rr"].mean()), "high": float(g["rr"].mean())}

    # one partition more than shuffles have: an exchange by key that is there already would be kept, and being small made one task
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, "key")
    return per_key(spread, "k double, low double, high double", kernel)


def band_rhythms(rows: DataFrame) -> DataFrame:
    return per_key(rows, "power double, period double, score double", lambda g: K.band_rhythm(g["angle"].to_numpy(float), g["rr"].to_numpy(float)))


def modulations(rows: DataFrame) -> DataFrame:
    return per_key(rows, "depth double, period double", lambda g: K.modulation(g["rr"].to_numpy(float)))


def periodicity(rows: DataFrame) -> DataFrame:
    """Pattern of the places where flag is set."""
    return per_key(rows, "pattern string", lambda g: {"pattern": K.periodic_indices(np.flatnonzero(g["flag"].to_numpy()))})


def recording_features(recordings: DataFrame) -> DataFrame:
    """(id, lead, name, value) in long form from (id, fs, leads array<array<double>>): filtering, peaks, mean beat, scalars,
    morphology, quality, ST. Long rows keep a plan narrow however many features a model screens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.stack([np.nan_to_num(np.asarray(v, float), posinf=0.0, neginf=0.0) for v in r.leads])
                y, clean = K.preprocess(x, r.fs)
                peaks = K.r_peaks(K.energy(y), r.fs)
                out = [("all", "n_beats", float(len(peaks))), ("all", "clean", float(clean))]
                out += [(plane, k, v) for plane, k, v in K.plane_angles(y, peaks)]
                for lead, signal, raw in zip(K.LEADS, y, x, strict=False):
                    beat = K.average_beat(signal, peaks)
                    out += [(lead, k, float(v)) for k, v in K.band_quality(raw, r.fs).items()]
                    if len(peaks) > 3:
                        drift = K.anchored_baseline(raw, (peaks[1:] + peaks[:-1]) // 2, int(0.04 * r.fs))
                        out.append((lead, "baseline_sd", float(drift.std())))
                    if len(beat) > 10:
                        beat = np.nan_to_num(beat)
                        out += [(lead, k, float(v)) for part in (K.base_scalars(beat, r.fs), K.morphology(beat), K.st_measures(beat, int(np.abs(beat).argmax()), r.fs)) for k, v in part.items()]
                yield pd.DataFrame([(r.id, *f) for f in out], columns=["id", "lead", "name", "value"])

    return recordings.select("id", "fs", "leads").mapInPandas(run, "id long, lead string, name string, value double")


def savgol(column: str) -> Column:
    """Smoothing of an array column over five samples by a parabola, as column expressions; the ends stay as they are."""
    x = F.col(column)
    weights = (-3.0, 12.0, 17.0, 12.0, -3.0)
    n = F.size(x)
    inner = lambda i: sum(F.element_at(x, (i + k).cast("int")) * w for k, w in zip(range(-2, 3), weights, strict=True)) / 35
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when((i > 2) & (i <= n - 2), inner(i)).otherwise(F.element_at(x, i)))


def trapezoid(x: Column, y: Column) -> Column:
    """Integral of y over x, both arrays."""
    z = F.arrays_zip(x.alias("x"), y.alias("y"))
    steps = F.zip_with(F.slice(z, 1, F.size(z) - 1), F.slice(z, 2, F.size(z) - 1), lambda a, b: (b["x"] - a["x"]) * (a["y"] + b["y"]) / 2)
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)
