"""Exact nearest neighbours of a query set by blocks, votes and weighted centroids, template distances, planar tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, TILE = 8192, 256


def nearest(rows: DataFrame, queries: DataFrame, k: int, include_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, distance): the k rows nearest to each query by Euclidean distance, ties to the smaller id.

    Rows (id, v) and queries (id, v) are dealt to blocks of about `block` by a hash; each pair of blocks is one group. In it a
    matrix product gives all distances roughly; those that can be among the k smallest are computed again from the differences,
    and only k rows for each query leave. Blocks bound a group's size, not its number.
    """
    a, b = max(1, math.ceil(rows.count() / block)), max(1, math.ceil(queries.count() / block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    left = rows.select("id", "v", deal(a).alias("r"), F.explode(F.expr(f"sequence(0L, {b - 1}L)")).alias("q"))
    right = queries.select("id", "v", F.explode(F.expr(f"sequence(0L, {a - 1}L)")).alias("r"), deal(b).alias("q"))

    def search(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []}).astype({"query_id": "int64", "id": "int64"})
        x = np.stack(rows["v"].to_numpy())
        ids = rows["id"].to_numpy()
        found = []
        for at in range(0, len(queries), TILE):
            part = queries.iloc[at : at + TILE]
            y, asked = np.stack(part["v"].to_numpy()), part["id"].to_numpy()
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            rough = yy[:, None] + xx[None] - 2 * (y @ x.T)
            if not include_self:
                rough[asked[:, None] == ids[None]] = np.inf
            slack = 1e-9 * (yy[:, None] + xx.max() + 1)
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.full((len(y), 1), np.finfo(float).max)
            q, c = np.nonzero(rough <= edge + slack)
            d = np.sqrt(((x[c] - y[q]) ** 2).sum(axis=1))
            order = np.lexsort((ids[c], d, q))
            q, c, d = q[order], c[order], d[order]
            first = np.searchsorted(q, np.arange(len(y)))
            top = np.arange(len(q)) - first[q] < k
            found.append(pd.DataFrame({"query_id": asked[q[top]], "id": ids[c[top]], "distance": d[top]}))
        return pd.concat(found)

    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInPandas(search, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def weighted_centroid(near: DataFrame, places: DataFrame, *axes: str) -> DataFrame:
    """For each query the mean of its neighbours' places, weighted by 1 / (distance + 1e-9)."""
    w = 1 / (F.col("distance") + 1e-9)
    both = near.join(places, "id").withColumn("w", w)
    return both.groupBy("query_id").agg(*[(F.sum(F.col(a) * F.col("w")) / F.sum("w")).alias(a) for a in axes])


def label_vote(near: DataFrame, labels: DataFrame) -> DataFrame:
    """How many neighbours carry the query's label; not backed if that is at most half of them."""
    other = near.join(labels.select("id", F.col("label").alias("other")), "id")
    own = other.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    out = own.groupBy("query_id", "own").agg(F.count("*").alias("total"), F.count_if(F.col("own") == F.col("other")).alias("carrying"))
    return out.withColumn("backed", 2 * F.col("carrying") > F.col("total"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def template_distances(rows: DataFrame, templates: DataFrame, most_templates: int = 10_000, salts: int = 64) -> DataFrame:
    """(id, label, euclidean, cosine, max_z, mean_z, over2, mahalanobis) of each row and template (label, mean, sd, n).

    Every record meets every class, by definition. Up to `most_templates` templates are broadcast; more are dealt to blocks of
    about that many, and rows are copied to each block, salted so that a block is not one task. Cosine is 0 if a norm is tiny;
    dimensions with hardly any spread are left out of z; the diagonal Mahalanobis distance needs three members.
    """
    blocks = math.ceil(templates.count() / most_templates)
    if blocks <= 1:
        both = rows.join(F.broadcast(templates))
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(salts).cast("long")).alias("_salt")
        copied = rows.select("*", salt, F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("_block"))
        dealt = templates.select("*", F.pmod(F.xxhash64("label"), F.lit(blocks).cast("long")).alias("_block"), F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("_salt"))
        both = copied.join(dealt, ["_block", "_salt"])
    diff = F.zip_with("v", "mean", lambda x, m: x - m)
    z = F.zip_with(diff, "sd", lambda d, s: F.when(s > 1e-9, F.abs(d) / s))
    some = F.filter(z, lambda x: x.isNotNull())
    norm = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("mean"), F.col("mean")))
    total = F.aggregate(some, F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(some, F.lit(0.0), lambda s, x: s + x * x)
    return both.select(
        "id", "label",
        F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)).alias("euclidean"),
        F.when(norm < 1e-12, 0.0).otherwise(dot(F.col("v"), F.col("mean")) / norm).alias("cosine"),
        F.array_max(some).alias("max_z"), F.try_divide(total, F.size(some)).alias("mean_z"),
        F.size(F.filter(some, lambda x: x > 2)).alias("over2"), F.when(F.col("n") >= 3, F.sqrt(square)).alias("mahalanobis"),
    )


def templates(rows: DataFrame) -> DataFrame:
    """(label, mean, sd, n) from (label, v): per dimension mean and population deviation."""
    long = rows.select("label", F.posexplode("v").alias("p", "x"))
    each = long.groupBy("label", "p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n"))
    packed = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("p", "m", "s"))).alias("a"), F.max("n").alias("n"))
    return packed.select("label", F.col("a.m").alias("mean"), F.col("a.s").alias("sd"), "n")


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon: an odd number of edges crosses the ray to its right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        spans = (F.lit(y1) > y) != (F.lit(y2) > y)
        at = F.lit(x1) + (y - y1) * (x2 - x1) / (y2 - y1) if y1 != y2 else F.lit(0.0)
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def affine_fit(rows: DataFrame, predictors: list[str], target: str) -> tuple[np.ndarray, float]:
    """Least-squares coefficients (the constant last) and the root mean square residual, from one aggregate of products."""
    names = [*predictors, "_one"]
    both = rows.withColumn("_one", F.lit(1.0))
    grams = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    sums = [F.sum(F.col(a) * F.col(target)).alias(f"t{i}") for i, a in enumerate(names)]
    row = both.agg(*grams, *sums, F.sum(F.col(target) ** 2).alias("yy"), F.count("*").alias("n")).first()
    gram = np.array([[row[f"g{i}_{j}"] for j in range(len(names))] for i in range(len(names))])
    moment = np.array([row[f"t{i}"] for i in range(len(names))])
    beta = np.linalg.lstsq(gram, moment, rcond=None)[0]
    rest = row["yy"] - 2 * beta @ moment + beta @ gram @ beta
    return beta, math.sqrt(max(0.0, rest) / row["n"])
