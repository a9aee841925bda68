"""Neighbours, centroids and scores on the embeddings table; queries are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.operators import neighbours as N
from sparkwright.session import table

CLASSES, K = 8, 6
POLYGON = [(-0.1, -0.1), (0.15, -0.05), (0.1, 0.12), (-0.05, 0.05)]


def vectors(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def places(spark, d: str) -> DataFrame:
    return vectors(spark, d).select("id", "label", *[F.col("v")[i].alias(c) for i, c in enumerate("xyz")])


def scores(spark, d: str) -> DataFrame:
    """(id, class, p, threshold): made-up class probabilities from the first dimensions; class c8 has no threshold."""
    v = vectors(spark, d).select("id", F.posexplode(F.slice("v", 1, CLASSES)).alias("i", "x"))
    threshold = F.when(F.col("i") < CLASSES - 1, 0.3 + F.col("i") * 0.05)
    return v.select("id", F.concat(F.lit("c"), F.col("i") + 1).alias("class"), F.round(1 / (1 + F.exp(-8 * F.col("x"))), 9).alias("p"), threshold.alias("threshold"))


def _queries(spark, d):
    return vectors(spark, d).where("id % 100 = 0").select("id", "v")


def _near(spark, d, include_self=False):
    return N.nearest(vectors(spark, d).select("id", "v"), _queries(spark, d), K, include_self)


def knn_exact(spark, d):
    return _near(spark, d, True).withColumn("distance", F.round("distance", 6))


def knn_leave_self_out(spark, d):
    return _near(spark, d).withColumn("distance", F.round("distance", 6))


def knn_display_space(spark, d):
    """Neighbours in the three display dimensions among the rows of even label."""
    p = places(spark, d).withColumn("v", F.array("x", "y", "z"))
    return N.nearest(p.where("label % 2 = 0").select("id", "v"), p.where("id % 100 = 0").select("id", "v"), 4).withColumn("distance", F.round("distance", 6))


def knn_label_vote(spark, d):
    return N.label_vote(_near(spark, d), vectors(spark, d).select("id", "label"))


def knn_weighted_centroid(spark, d):
    out = N.weighted_centroid(_near(spark, d), places(spark, d).drop("label"), "x", "y", "z")
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in "xyz"])


def neighbour_enrichment(spark, d):
    """Neighbours with their labels, the query itself left out, the first three of each."""
    near = _near(spark, d, True).where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    both = near.join(vectors(spark, d).select("id", "label"), "id", "left").withColumn("place", rank)
    return both.where("place <= 3").select("query_id", "place", "id", "label")


def centroid_by_label(spark, d):
    return places(spark, d).groupBy("label").agg(*[F.round(F.avg(c), 6).alias(c) for c in "xyz"], F.count("*").alias("n"))


def template_distances(spark, d):
    rows = vectors(spark, d)
    out = N.template_distances(rows.select("id", "v"), N.templates(rows))
    return out.select("id", "label", "over2", *[F.round(c, 6).alias(c) for c in ("euclidean", "cosine", "max_z", "mean_z", "mahalanobis")])


def nearest_template(spark, d):
    out = template_distances(spark, d)
    return out.groupBy("id").agg(F.min_by("label", F.struct("euclidean", "label")).alias("label"), F.min("euclidean").alias("euclidean"))


def scale_factor(spark, d):
    top = F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))
    return places(spark, d).agg(F.round(F.coalesce(F.try_divide(F.lit(10.0), top), F.lit(1.0)), 6).alias("scale"))


def padded_bounds(spark, d):
    b = places(spark, d).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    pad = lambda a, z: F.when(F.col(z) > F.col(a), 0.1 * (F.col(z) - F.col(a))).otherwise(1.0)
    return b.select(*[F.round(e, 6).alias(n) for e, n in ((F.col("x0") - pad("x0", "x1"), "x0"), (F.col("x1") + pad("x0", "x1"), "x1"), (F.col("y0") - pad("y0", "y1"), "y0"), (F.col("y1") + pad("y0", "y1"), "y1"))])


def point_in_polygon(spark, d):
    return places(spark, d).where(N.in_polygon(F.col("x"), F.col("y"), POLYGON)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def affine_line(spark, d):
    """One predictor by the closed form, with its residual."""
    beta, rest = N.affine_fit(places(spark, d), ["x"], "y")
    return spark.createDataFrame([(round(float(beta[0]), 6), round(float(beta[1]), 6), round(rest, 6))], "slope double, intercept double, rms double")


def affine_map_residual(spark, d):
    """Root mean square residual of each display axis fitted to the class scores."""
    wide = vectors(spark, d).select("id", *[F.col("v")[i].alias(f"p{i}") for i in range(8, 16)], *[F.col("v")[i].alias(c) for i, c in enumerate("xyz")])
    return spark.createDataFrame([(c, round(N.affine_fit(wide, [f"p{i}" for i in range(8, 16)], c)[1], 6)) for c in "xyz"], "axis string, rms double")


def threshold_calls(spark, d):
    """Classes at or above their threshold (0.5 where it is missing), highest first, and the top class."""
    s = scores(spark, d)
    called = F.filter(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), F.col("class"), (F.col("p") >= F.coalesce("threshold", F.lit(0.5))).alias("on")))), lambda x: x["on"])
    return s.groupBy("id").agg(F.array_join(F.transform(called, lambda x: x["class"]), ",").alias("called"), F.min_by("class", F.struct(-F.col("p"), F.col("class"))).alias("top"))


def above_threshold(spark, d):
    t = F.coalesce(F.nullif("threshold", F.lit(0.0)), F.lit(0.5))
    return scores(spark, d).where(F.col("p") >= t).select("id", "class", F.round("p", 6).alias("p"), F.round(F.col("p") / t, 6).alias("ratio"))


def _ranked(spark, d, condition, k):
    t = F.coalesce(F.nullif("threshold", F.lit(0.0)), F.lit(0.5))
    s = scores(spark, d).withColumn("t", t).where(condition).withColumn("ratio", F.round(F.col("p") / F.col("t"), 6))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ratio"), "class"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "class", "ratio")


def differential(spark, d):
    return _ranked(spark, d, "p > 0.2 * t", 8)


def near_miss(spark, d):
    return _ranked(spark, d, "p < t and p > 0.2 * t", 6)


def top_k_scores(spark, d):
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("p"), "class"))
    return scores(spark, d).withColumn("rank", rank).where("rank <= 3").select("id", "rank", "class", F.round("p", 6).alias("p"))


def fold_mean_spread(spark, d):
    """Dimensions 11 to 15 as the scores of five folds: mean, least, greatest and range."""
    f = vectors(spark, d).select("id", F.slice("v", 11, 5).alias("f"))
    mean = F.aggregate("f", F.lit(0.0), lambda s, x: s + x) / F.size("f")
    return f.select("id", *[F.round(e, 6).alias(n) for e, n in ((mean, "mean"), (F.array_min("f"), "low"), (F.array_max("f"), "high"), (F.array_max("f") - F.array_min("f"), "spread"))])


def stored_vs_live(spark, d):
    """Scores against their stored form, rounded to three decimals: the greatest difference by class."""
    live = scores(spark, d).select("id", "class", "p")
    stored = scores(spark, d).select("id", "class", F.round("p", 3).alias("stored"))
    return live.join(stored, ["id", "class"]).groupBy("class").agg(F.round(F.max(F.abs(F.col("p") - F.col("stored"))), 6).alias("max_delta"), F.count("*").alias("n"))


def joined_by_index(spark, d):
    """Rows and a score matrix by index; rows outside the matrix are skipped."""
    rows, matrix = _indexed(spark, d)
    return rows.join(matrix, "idx").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


def roc_rows_by_index(spark, d):
    """For a ROC curve rows outside the matrix stay, with score 0 and label 0."""
    rows, matrix = _indexed(spark, d)
    out = rows.join(matrix, "idx", "left").select("lang", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("y", F.lit(0)).alias("y"), F.col("score").isNotNull().alias("inside"))
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("inside").alias("inside"), F.sum("y").alias("positive"), F.round(F.sum("score"), 6).alias("total"))


def _indexed(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "lang")
    return rows, vectors(spark, d).select(F.col("id").alias("idx"), F.col("v")[0].alias("score"), (F.col("label") % 2).cast("int").alias("y"))


QUERIES = {f.__name__: f for f in (
    knn_exact, knn_leave_self_out, knn_display_space, knn_label_vote, knn_weighted_centroid, neighbour_enrichment, centroid_by_label,
    template_distances, nearest_template, scale_factor, padded_bounds, point_in_polygon, affine_line, affine_map_residual, threshold_calls,
    above_threshold, differential, near_miss, top_k_scores, fold_mean_spread, stored_vs_live, joined_by_index, roc_rows_by_index,
)}

V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT id, label, v[1] AS x, v[2] AS y, v[3] AS z FROM v)"
_KNN = f"""WITH {V}, d AS (SELECT q.id AS query_id, c.id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda e: (e[1] - e[2]) * (e[1] - e[2])))) AS distance FROM v q, v c WHERE q.id % 100 = 0),
 nearself AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d QUALIFY rank <= {K}),
 near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d WHERE query_id <> id QUALIFY rank <= {K})"""
_T = f"""WITH {V}, l AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v), t AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM l GROUP BY label, i),
 j AS (SELECT l.id, t.label, l.x, t.m, t.n, CASE WHEN t.s > 1e-9 THEN abs(l.x - t.m) / t.s END AS z FROM l JOIN t ON l.i = t.i),
 td AS (SELECT id, label, count(*) FILTER (z > 2)::INT AS over2, round(sqrt(sum((x - m) * (x - m))), 6) AS euclidean, round(CASE WHEN sqrt(sum(x * x)) * sqrt(sum(m * m)) < 1e-12 THEN 0 ELSE sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) END, 6) AS cosine,
 round(max(z), 6) AS max_z, round(avg(z), 6) AS mean_z, round(CASE WHEN any_value(n) >= 3 THEN sqrt(sum(z * z)) END, 6) AS mahalanobis FROM j GROUP BY id, label)"""
_SC = f"""WITH {V}, sc AS (SELECT id, 'c' || i AS class, round(1 / (1 + exp(-8 * x)), 9) AS p, CASE WHEN i < {CLASSES} THEN 0.3::DOUBLE + (i - 1) * 0.05::DOUBLE END AS threshold FROM (SELECT id, unnest(v[1:{CLASSES}]) AS x, unnest(range(1, {CLASSES + 1})) AS i FROM v)),
 st AS (SELECT *, coalesce(nullif(threshold, 0), 0.5)::DOUBLE AS t FROM sc)"""
_EDGES = " + ".join(f"(CASE WHEN (({y1} > y) <> ({y2} > y)) AND x < {x1} + (y - ({y1})) * ({x2} - ({x1})) / ({y2} - ({y1})) THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True))
_RANK = " SELECT id, row_number() OVER (PARTITION BY id ORDER BY round(p / t, 6) DESC, class) AS rank, class, round(p / t, 6) AS ratio FROM st WHERE {w} QUALIFY rank <= {k}"

ORACLES = {
    "knn_exact": _KNN + " SELECT query_id, rank, id, round(distance, 6) AS distance FROM nearself",
    "knn_leave_self_out": _KNN + " SELECT query_id, rank, id, round(distance, 6) AS distance FROM near",
    "knn_display_space": f"WITH {V} SELECT q.id AS query_id, c.id, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) + (q.z - c.z) * (q.z - c.z)), c.id) AS rank, round(sqrt((q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) + (q.z - c.z) * (q.z - c.z)), 6) AS distance FROM p q, p c WHERE q.id % 100 = 0 AND c.label % 2 = 0 AND q.id <> c.id QUALIFY rank <= 4",
    "knn_label_vote": _KNN + " SELECT query_id, q.label AS own, count(*) AS total, count(*) FILTER (q.label = c.label) AS carrying, 2 * count(*) FILTER (q.label = c.label) > count(*) AS backed FROM near JOIN v q ON q.id = query_id JOIN v c ON c.id = near.id GROUP BY query_id, q.label",
    "knn_weighted_centroid": _KNN + " SELECT query_id, " + ", ".join(f"round(sum(p.{c} / (distance + 1e-9)) / sum(1 / (distance + 1e-9)), 6) AS {c}" for c in "xyz") + " FROM near JOIN p ON p.id = near.id GROUP BY query_id",
    "neighbour_enrichment": _KNN + " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, s.id, v.label FROM nearself s LEFT JOIN v ON v.id = s.id WHERE query_id <> s.id QUALIFY place <= 3",
    "centroid_by_label": f"WITH {V} SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM p GROUP BY label",
    "template_distances": _T + " SELECT * FROM td",
    "nearest_template": _T + " SELECT id, label, euclidean FROM td QUALIFY row_number() OVER (PARTITION BY id ORDER BY euclidean, label) = 1",
    "scale_factor": f"WITH {V} SELECT round(coalesce(10 / nullif(max(greatest(abs(x), abs(y), abs(z))), 0), 1), 6) AS scale FROM p",
    "padded_bounds": f"WITH {V}, b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p), q AS (SELECT *, CASE WHEN b > a THEN 0.1 * (b - a) ELSE 1 END AS px, CASE WHEN d > c THEN 0.1 * (d - c) ELSE 1 END AS py FROM b) SELECT round(a - px, 6) AS x0, round(b + px, 6) AS x1, round(c - py, 6) AS y0, round(d + py, 6) AS y1 FROM q",
    "point_in_polygon": f"WITH {V} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE ({_EDGES}) % 2 = 1",
    "affine_line": f"WITH {V}, f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p) SELECT round(s, 6) AS slope, round(i, 6) AS intercept, (SELECT round(sqrt(avg((y - s * x - i) * (y - s * x - i))), 6) FROM p, f) AS rms FROM f",
    "threshold_calls": _SC + " SELECT id, coalesce(string_agg(class, ',' ORDER BY p DESC, class) FILTER (p >= coalesce(threshold, 0.5)), '') AS called, first(class ORDER BY p DESC, class) AS top FROM sc GROUP BY id",
    "above_threshold": _SC + " SELECT id, class, round(p, 6) AS p, round(p / t, 6) AS ratio FROM st WHERE p >= t",
    "differential": _SC + _RANK.format(w="p > 0.2 * t", k=8),
    "near_miss": _SC + _RANK.format(w="p < t AND p > 0.2 * t", k=6),
    "top_k_scores": _SC + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS rank, class, round(p, 6) AS p FROM sc QUALIFY rank <= 3",
    "fold_mean_spread": f"WITH {V}, f AS (SELECT id, v[11:15] AS f FROM v) SELECT id, round(list_sum(f) / 5, 6) AS mean, round(list_min(f), 6) AS low, round(list_max(f), 6) AS high, round(list_max(f) - list_min(f), 6) AS spread FROM f",
    "stored_vs_live": _SC + " SELECT class, round(max(abs(p - round(p, 3))), 6) AS max_delta, count(*) AS n FROM sc GROUP BY class",
    "joined_by_index": f"WITH {V} SELECT lang, count(*) AS n, round(sum(v.v[1]), 6) AS total FROM documents JOIN v ON v.id = doc_id GROUP BY lang",
    "roc_rows_by_index": f"WITH {V} SELECT lang, count(*) AS n, count(v.id) AS inside, sum(coalesce(label % 2, 0))::BIGINT AS positive, round(sum(coalesce(v.v[1], 0)), 6) AS total FROM documents LEFT JOIN v ON v.id = doc_id GROUP BY lang",
}
