"""Packages of tree models, one for each class and fold: loading, mean probabilities, and contributions of features.

A package is a folder <class>/<fold> of saved Spark ML tree ensembles. What they predict and why comes from their node tables,
whose size is that of the models; rows are scored in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trees:
    """The trees of one fold as arrays over their nodes; a leaf's children are -1. Values left of a threshold are <= it; missing
    ones go left where `missing_left` says so. `cover` is the number (weight) of training rows that a node saw."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    missing_left: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def paths(self, root: int) -> tuple[np.ndarray, ...]:
        """Of each leaf of a tree: its value and, for each different feature on its path (padded to the longest path with -1), the
        feature, the bounds low < x <= high, whether missing values pass, and the share of rows that pass by the covers alone."""
        leaves = []
        todo = [(int(root), {})]
        while todo:
            at, held = todo.pop()
            if self.left[at] < 0:
                leaves.append((float(self.value[at]), held))
                continue
            f, t = int(self.feature[at]), float(self.threshold[at])
            for child, goes_left in ((self.right[at], False), (self.left[at], True)):
                low, high, missing, share = held.get(f, (-np.inf, np.inf, True, 1.0))
                share *= self.cover[child] / self.cover[at] if self.cover[at] > 0 else 0.0
                missing = missing and bool(self.missing_left[at]) == goes_left
                bounds = (low, min(high, t)) if goes_left else (max(low, t), high)
                todo.append((int(child), held | {f: (*bounds, missing, share)}))
        longest = max(1, max(len(h) for _, h in leaves))
        none = (-1, -np.inf, np.inf, True, 1.0)
        rows = [[(f, *v) for f, v in h.items()] + [none] * (longest - len(h)) for _, h in leaves]
        columns = [np.array([[part[c] for part in r] for r in rows]) for c in range(5)]
        return np.array([v for v, _ in leaves]), *columns

    def shapley(self, x: np.ndarray, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """(base, Shapley value of each feature) of each row: the mean of what a feature changes over all orders in which features
        become known, where an unknown one sends a row both ways by the covers. Base and values sum to the ensemble's output.

        A leaf pays to the features on its path only. The sum over subsets of a size of what known (1 or 0) and unknown features (their
        share) let through is a coefficient of the product of (share + known y); the product is extended by one feature after the
        other, and each feature in turn is unwound from it. Features that fill up short paths let all through and get nothing.
        """
        base, out = 0.0, np.zeros(x.shape)
        for root, weight in zip(self.roots, self.weights, strict=True):
            value, feature, low, high, missing, share = self.paths(int(root))
            base += float(weight) * float(value @ share.prod(axis=1))
            d = feature.shape[1]
            sizes = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
            step = max(1, block // (len(value) * (d + 1)))
            for begin in range(0, len(x), step):
                own = x[begin : begin + step][:, np.maximum(feature, 0)]  # rows x leaves x features of the path
                known = np.where(np.isnan(own), missing, (own > low) & (own <= high)).astype(float)
                product = np.zeros((*known.shape[:2], d + 1))
                product[..., 0] = 1
                for k in range(d):
                    moved = product[..., : k + 1] * known[..., k, None]
                    product[..., : k + 1] *= share[:, k, None]
                    product[..., 1 : k + 2] += moved
                for i in range(d):
                    z, o = share[:, i], known[..., i]
                    rest = np.zeros((*known.shape[:2], d))
                    carried = np.zeros(known.shape[:2])
                    for k in range(d - 1, -1, -1):  # divide by (z + y) from the highest power down where the feature passes
                        carried = product[..., k + 1] - z * carried
                        rest[..., k] = carried
                    closed = product[..., :d] / np.where(z > 0, z, 1.0)[:, None]  # without it the feature is a factor z
                    rest = np.where(o[..., None] > 0, rest, closed)
                    pays = (o - z) * value * (rest @ sizes)
                    for f in np.unique(feature[:, i]):
                        if f >= 0:
                            out[begin : begin + step, f] += float(weight) * pays[:, feature[:, i] == f].sum(axis=1)
        return np.full(len(x), base), out


def read_trees(spark: SparkSession, path: str) -> Trees:
    """A saved tree ensemble with splits by thresholds; its node table comes to the driver, as large as the model."""
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").toPandas()
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").orderBy("treeID").select("weights").toPandas()["weights"].to_numpy(float)
    place = {key: i for i, key in enumerate(zip(nodes["treeID"], nodes["id"], strict=True))}
    child = lambda c: np.array([place.get((t, k), -1) if k >= 0 else -1 for t, k in zip(nodes["treeID"], nodes[c], strict=True)])
    threshold = np.array([s["leftCategoriesOrThreshold"][0] if s["featureIndex"] >= 0 else 0.0 for s in nodes["split"]])
    roots = np.array([place[(t, 0)] for t in sorted(nodes["treeID"].unique())])
    feature, cover = np.array([s["featureIndex"] for s in nodes["split"]]), nodes["rawCount"].to_numpy(float)
    return Trees(feature, threshold, child("leftChild"), child("rightChild"), nodes["prediction"].to_numpy(float), cover, np.zeros(len(nodes), bool), roots, weights)


def load_package(spark: SparkSession, path: str, classes: list[str], folds: int) -> dict[str, list[Trees]]:
    return {c: [read_trees(spark, f"{path}/{c}/{k}") for k in range(folds)] for c in classes}


def explain(rows: DataFrame, package: dict[str, list[Trees]], features: list[str]) -> DataFrame:
    """(id, class, p, base, values) of rows (id, features...): the mean over folds of the probability (logistic of twice the output)
    and of the Shapley value of each feature for the output. A null feature counts as not a number, which goes to the right."""
    shared = rows.sparkSession.sparkContext.broadcast(package)  # as large as the models

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(float)
            for name, folds in shared.value.items():
                parts = [f.shapley(x) for f in folds]
                base, values = np.mean([b for b, _ in parts], axis=0), np.mean([v for _, v in parts], axis=0)
                p = np.mean([1 / (1 + np.exp(-2 * (b + v.sum(axis=1)))) for b, v in parts], axis=0)
                yield pd.DataFrame({"id": batch["id"], "class": name, "p": p, "base": base, "values": list(values)})

    return rows.select("id", *[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(run, "id long, class string, p double, base double, values array<double>")


def top_features(explained: DataFrame, features: list[str], k: int = 10) -> DataFrame:
    """(id, class, rank, feature, value): the k features that add or take most; zeros are left out."""
    named = explained.select("id", "class", F.posexplode("values").alias("i", "value")).where("value <> 0")
    rank = F.row_number().over(Window.partitionBy("id", "class").orderBy(F.desc(F.abs("value")), "i"))
    top = named.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("id", "class", "rank", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("i") + 1).alias("feature"), "value")
