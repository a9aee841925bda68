"""Score metrics on labels and documents: score is a document's length, the class its quality label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.operators import metrics as M
from sparkwright.operators.ordering import running_totals
from sparkwright.session import table


def scored(spark, d: str) -> DataFrame:
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("idx"), F.col("quality").alias("y"), "toxic", F.col("n_chars").cast("double").alias("score"), "lang", "source", (F.col("doc_id") % 5).alias("fold"),
    )


S = "scored AS (SELECT d.doc_id AS idx, l.quality AS y, l.toxic, d.n_chars::DOUBLE AS score, d.lang, d.source, d.doc_id % 5 AS fold FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
G = f"WITH {S}, g AS (SELECT score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM scored GROUP BY score)"
RATES = """round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS sens, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS spec,
 round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS ppv, round(tn::DOUBLE / nullif(tn + fn, 0), 6) AS npv, round(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 6) AS f1"""
COUNTS = """count(*) FILTER (score >= {t} AND y = 1) AS tp, count(*) FILTER (score >= {t} AND y = 0) AS fp,
 count(*) FILTER (score < {t} AND y = 0) AS tn, count(*) FILTER (score < {t} AND y = 1) AS fn"""
THRESHOLDS = [0.0, 100.0, 500.0, 1000.0, 2000.0, 5000.0, 20000.0]


def roc_curve(spark, d):
    return M.roc_curve(scored(spark, d))


def roc_curve_thinned(spark, d):
    rows = scored(spark, d)
    ordered = running_totals(M.by_score(rows).withColumn("one", F.lit(1)), "score", ["pos", "neg", "one"], descending=True)
    n = ordered.count()
    out = ordered.select(F.col("one_before").cast("long").alias("i"), "score", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))
    return M.thin_curve(out, n, 100)


def auroc_rank(spark, d):
    return M.auroc_rank(scored(spark, d)).select(F.round("auroc", 6).alias("auroc"), "n_pos", "n_neg")


def auroc_staircase(spark, d):
    return M.auroc_staircase(scored(spark, d)).select(F.round("auroc", 6).alias("auroc"))


def operating_point(spark, d):
    return M.confusion(scored(spark, d), F.lit(1000.0)).select(F.round(F.col("sens"), 5).alias("tpr"), F.round(1 - F.col("spec"), 5).alias("fpr"))


def confusion_at_threshold(spark, d):
    return M.confusion(scored(spark, d), F.lit(1000.0))


def threshold_sweep(spark, d):
    return M.threshold_sweep(scored(spark, d), THRESHOLDS)


def f1_optimal_threshold(spark, d):
    return M.best_f1(scored(spark, d))


def oof_threshold(spark, d):
    return M.out_of_fold_thresholds(scored(spark, d), 5)


def auroc_by_negative_group(spark, d):
    return M.auroc_by_negatives(scored(spark, d), "lang").select("lang", F.round("auroc", 6).alias("auroc"), "n_neg", F.round("weight", 6).alias("weight"))


def auroc_group_identity(spark, d):
    rows = scored(spark, d)
    parts = M.auroc_by_negatives(rows, "lang").agg(F.round(F.sum(F.col("weight") * F.col("auroc")), 6).alias("weighted"))
    return parts.join(F.broadcast(M.auroc_rank(rows).select(F.round("auroc", 6).alias("pooled"))))


def auroc_by_source_macro(spark, d):
    each = M.auroc_rank_by(scored(spark, d), "source")
    return each.agg(F.round(F.avg("auroc"), 6).alias("macro_auroc"), F.count("auroc").alias("n_classes"), F.count("*").alias("n_groups"))


def stratified_auroc(spark, d):
    rows = scored(spark, d)
    cuts = rows.agg(F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = lambda i: F.col("q")[i]
    part = F.when(F.col("score") <= q(0), 0).when(F.col("score") <= q(1), 1).when(F.col("score") <= q(2), 2).otherwise(3)
    each = M.auroc_rank_by(rows.join(F.broadcast(cuts)).withColumn("stratum", part), "stratum")
    return each.select("stratum", F.round("auroc", 6).alias("auroc"), "n_pos", "n_neg")


def stratified_auroc_mean(spark, d):
    each = stratified_auroc(spark, d).where("auroc is not null").withColumn("n", F.col("n_pos") + F.col("n_neg"))
    return each.agg(F.round(F.sum(F.col("auroc") * F.col("n")) / F.sum("n"), 5).alias("weighted_auroc"), F.count("*").alias("n_strata"))


def flag_rate_by_group(spark, d):
    flag = (F.col("score") >= 1000).cast("int")
    return scored(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(flag).cast("long").alias("flagged"), F.round(F.avg(flag), 6).alias("rate"))


def enrichment_ratio(spark, d):
    rows = scored(spark, d).withColumn("flag", F.col("score") >= 1000)
    whole = rows.agg(F.count("*").alias("n"), F.count_if("flag").alias("f"))
    each = rows.groupBy("lang").agg(F.count("*").alias("n_base"), F.count_if("flag").alias("n_flagged"))
    out = each.join(F.broadcast(whole)).withColumn("base", F.col("n_base") / F.col("n"))
    out = out.where((F.col("n_base") >= 10) & (F.col("base") > 0.002))
    return out.select("lang", "n_base", "n_flagged", F.round(F.col("n_flagged") / F.col("f") / F.col("base"), 6).alias("ratio"))


def permutation_control(spark, d, trials: int = 5):
    """Recovered label sets dealt anew within each language, `trials` times, by seeded hashes: true positives of the predictions
    against own and dealt labels in each trial, without and with the row's own recovered labels, and the share of the gain that
    is the row's own, from the mean of all trials. File order has no part."""
    rows = scored(spark, d).select("lang", "idx", F.lit(1).alias("one"), *_label_sets())
    truth = running_totals(rows.select("lang", "idx", "one", "preds", "own", "found"), "idx", ["one"], by=["lang"]).withColumnRenamed("one_before", "r").drop("one")
    each = rows.select("lang", "idx", "one", F.col("found").alias("fake"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    mark = F.md5(F.concat(F.col("trial").cast("string"), F.lit(":"), F.col("idx").cast("string")).cast("binary"))
    each = each.withColumn("mark", F.conv(F.substring(mark, 1, 15), 16, 10).cast("long"))
    dealt = running_totals(each, "mark", ["one"], by=["lang", "trial"], ties=["idx"]).select("lang", "trial", F.col("one_before").alias("r"), "fake")
    hits = lambda *sets: F.sum(F.size(F.array_intersect("preds", F.array_distinct(F.concat(*sets))))).cast("long")
    found = truth.join(dealt, ["lang", "r"]).groupBy("trial").agg(hits("own", "fake").alias("shuffled"), hits("own").alias("before"), hits("own", "found").alias("real"))
    mean = F.broadcast(found.agg(F.avg("shuffled").alias("mean")))  # one row
    gain = F.col("real") - F.col("before")
    return found.join(mean).select("trial", "shuffled", "before", "real", F.round(F.try_divide(gain - (F.col("mean") - F.col("before")), gain), 6).alias("own_share"))


def _label_sets() -> list:
    """Predicted, own and recovered label sets of a scored row."""
    pick = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))
    return [
        pick((F.col("score") >= 1000, "good"), (F.col("score") < 400, "toxic")).alias("preds"), pick((F.col("toxic") == 1, "toxic")).alias("own"),
        pick((F.col("y") == 1, "good")).alias("found"),
    ]


def bootstrap_ci(spark, d, replicates: int = 40):
    """Percentile interval of the AUROC over stratified bootstrap replicates, drawn by seeded hashes (Poisson weights)."""
    rows = scored(spark, d)
    u = (F.pmod(F.xxhash64("idx", "rep"), F.lit(1_000_003)) / F.lit(1_000_003.0))
    weight = F.lit(0)
    for edge in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941):
        weight = weight + F.when(u >= edge, 1).otherwise(0)
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight).where("w > 0")
    grouped = drawn.groupBy("rep", "score").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"))
    ranked = running_totals(grouped, "score", ["neg"], by=["rep"])
    each = ranked.groupBy("rep").agg((F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auroc"))
    return each.agg(F.percentile("auroc", F.lit(0.025)).alias("low"), F.avg("auroc").alias("mean"), F.percentile("auroc", F.lit(0.975)).alias("high"))


def multi_label_gain(spark, d):
    """True positives, precision and recall of predicted label sets before and after a union with recovered ones."""
    rows = scored(spark, d)
    sets = rows.select(
        F.array_compact(F.array(F.when(F.col("y") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("gold"),
        F.array_compact(F.array(F.when(F.col("score") >= 1000, "good"))).alias("before"),
        F.array_compact(F.array(F.when(F.col("score") < 400, "toxic"))).alias("found"),
    ).withColumn("after", F.array_union("before", "found"))
    both = lambda a, b: F.sum(F.size(F.array_intersect(a, b))).cast("long")
    size = lambda a: F.sum(F.size(a)).cast("long")
    out = sets.agg(both("gold", "before").alias("tp_before"), both("gold", "after").alias("tp_after"), size("gold").alias("n_gold"), size("before").alias("n_before"), size("after").alias("n_after"))
    return out.select("*", F.round(F.try_divide("tp_before", "n_before"), 6).alias("precision_before"), F.round(F.try_divide("tp_after", "n_after"), 6).alias("precision_after"), F.round(F.try_divide("tp_before", "n_gold"), 6).alias("recall_before"), F.round(F.try_divide("tp_after", "n_gold"), 6).alias("recall_after"))


def per_class_agreement(spark, d):
    rows = scored(spark, d)
    fired = F.array_compact(F.array(F.when(F.col("score") >= 1000, "quality"), F.when(F.col("score") < 400, "toxic")))
    gold = F.array_compact(F.array(F.when(F.col("y") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    each = rows.select(gold.alias("gold"), F.explode(fired).alias("class"))
    return each.groupBy("class").agg(F.count("*").alias("fired"), F.count_if(F.array_contains("gold", F.col("class"))).alias("tp"))


QUERIES = {f.__name__: f for f in (
    roc_curve, roc_curve_thinned, auroc_rank, auroc_staircase, operating_point, confusion_at_threshold, threshold_sweep, f1_optimal_threshold,
    oof_threshold, auroc_by_negative_group, auroc_group_identity, auroc_by_source_macro, stratified_auroc, stratified_auroc_mean,
    flag_rate_by_group, enrichment_ratio, permutation_control, bootstrap_ci, multi_label_gain, per_class_agreement,
)}

_BY_LANG = f"""WITH {S}, pairs AS (SELECT n.lang, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE AS auroc
 FROM scored p, scored n WHERE p.y = 1 AND n.y = 0 GROUP BY n.lang), sizes AS (SELECT lang, count(*) AS n_neg FROM scored WHERE y = 0 GROUP BY lang),
 each AS (SELECT lang, auroc, n_neg, n_neg / sum(n_neg) OVER () AS weight FROM pairs JOIN sizes USING (lang))"""
_STRATA = f"""WITH {S}, q AS (SELECT quantile_cont(score, [0.25, 0.5, 0.75]) AS q FROM scored),
 s AS (SELECT score, y, CASE WHEN score <= q[1] THEN 0 WHEN score <= q[2] THEN 1 WHEN score <= q[3] THEN 2 ELSE 3 END AS stratum FROM scored, q),
 each AS (SELECT stratum, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM s GROUP BY stratum),
 auc AS (SELECT p.stratum, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE AS a FROM s p JOIN s n ON p.stratum = n.stratum WHERE p.y = 1 AND n.y = 0 GROUP BY p.stratum),
 st AS (SELECT e.stratum, round(a, 6) AS auroc, n_pos, n_neg FROM each e LEFT JOIN auc ON e.stratum = auc.stratum)"""
_PAIRS = "avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE"

ORACLES = {
    "roc_curve": G + ", t AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC)) SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp::DOUBLE / p, 6) AS tpr, round(fp::DOUBLE / n, 6) AS fpr FROM t",
    "roc_curve_thinned": G + ", t AS (SELECT row_number() OVER w - 1 AS i, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, count(*) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC)) SELECT i::BIGINT AS i, score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM t WHERE i % greatest(1, n // 100) = 0 OR i = n - 1",
    "auroc_rank": f"WITH {S} SELECT (SELECT round({_PAIRS}, 6) FROM scored p, scored n WHERE p.y = 1 AND n.y = 0) AS auroc, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM scored",
    "auroc_staircase": f"WITH {S} SELECT round(avg(CASE WHEN p.score > n.score OR p.score = n.score AND p.idx < n.idx THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS auroc FROM scored p, scored n WHERE p.y = 1 AND n.y = 0",
    "operating_point": f"WITH {S}, c AS (SELECT {COUNTS.format(t='1000')} FROM scored), r AS (SELECT {RATES} FROM c) SELECT round(sens, 5) AS tpr, round(1 - spec, 5) AS fpr FROM r",
    "confusion_at_threshold": f"WITH {S}, c AS (SELECT {COUNTS.format(t='1000')} FROM scored) SELECT *, {RATES} FROM c",
    "threshold_sweep": f"WITH {S}, t AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold), c AS (SELECT threshold, {COUNTS.format(t='threshold')} FROM scored, t GROUP BY threshold) SELECT *, {RATES} FROM c",
    "f1_optimal_threshold": G + ", t AS (SELECT score, 2.0 * sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w + sum(pos) OVER ()) AS f FROM g WINDOW w AS (ORDER BY score DESC)) SELECT score AS threshold, round(f::DOUBLE, 6) AS f1 FROM t ORDER BY round(f::DOUBLE, 9) DESC, score LIMIT 1",
    "oof_threshold": f"WITH {S}, g AS (SELECT f.fold AS target, s.score, sum(y) AS pos, sum(1 - y) AS neg FROM scored s, (SELECT DISTINCT fold FROM scored) f WHERE s.fold <> f.fold GROUP BY f.fold, s.score), t AS (SELECT target, score, round((2.0 * sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w + sum(pos) OVER (PARTITION BY target)))::DOUBLE, 9) AS f FROM g WINDOW w AS (PARTITION BY target ORDER BY score DESC)), b AS (SELECT target, score AS threshold FROM t QUALIFY row_number() OVER (PARTITION BY target ORDER BY f DESC, score) = 1) SELECT fold, threshold, {COUNTS.format(t='threshold')} FROM scored JOIN b ON fold = target GROUP BY fold, threshold",
    "auroc_by_negative_group": _BY_LANG + " SELECT lang, round(auroc, 6) AS auroc, n_neg, round(weight, 6) AS weight FROM each",
    "auroc_group_identity": _BY_LANG + f" SELECT (SELECT round(sum(auroc * weight), 6) FROM each) AS weighted, (SELECT round({_PAIRS}, 6) FROM scored p, scored n WHERE p.y = 1 AND n.y = 0) AS pooled",
    "auroc_by_source_macro": f"WITH {S}, a AS (SELECT p.source, {_PAIRS} AS auroc FROM scored p JOIN scored n ON p.source = n.source WHERE p.y = 1 AND n.y = 0 GROUP BY p.source), s AS (SELECT DISTINCT source FROM scored) SELECT round(avg(auroc), 6) AS macro_auroc, count(auroc) AS n_classes, count(*) AS n_groups FROM s LEFT JOIN a USING (source)",
    "stratified_auroc": _STRATA + " SELECT * FROM st",
    "stratified_auroc_mean": _STRATA + " SELECT round(sum(auroc * (n_pos + n_neg)) / sum(n_pos + n_neg), 5) AS weighted_auroc, count(*) AS n_strata FROM st WHERE auroc IS NOT NULL",
    "flag_rate_by_group": f"WITH {S} SELECT source, count(*) AS n, sum((score >= 1000)::INT)::BIGINT AS flagged, round(avg((score >= 1000)::INT), 6) AS rate FROM scored GROUP BY source",
    "enrichment_ratio": f"WITH {S}, w AS (SELECT count(*) AS n, count(*) FILTER (score >= 1000) AS f FROM scored), e AS (SELECT lang, count(*) AS n_base, count(*) FILTER (score >= 1000) AS n_flagged FROM scored GROUP BY lang) SELECT lang, n_base, n_flagged, round((n_flagged::DOUBLE / f) / (n_base::DOUBLE / n), 6) AS ratio FROM e, w WHERE n_base >= 10 AND n_base::DOUBLE / n > 0.002",
    "permutation_control": f"WITH {S}, x AS (SELECT lang, idx, y, (score >= 1000)::INT AS g, CASE WHEN score < 400 AND toxic = 1 THEN 1 ELSE 0 END AS b FROM scored), a AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY idx) AS r, g, b, y FROM x), t AS (SELECT lang, trial, y, row_number() OVER (PARTITION BY lang, trial ORDER BY md5(trial || ':' || idx), idx) AS r FROM x, (SELECT unnest(range(1, 6))::INT AS trial)), f AS (SELECT trial, sum(b + g * t.y)::BIGINT AS shuffled, sum(b)::BIGINT AS before, sum(b + g * a.y)::BIGINT AS real FROM a JOIN t ON a.lang = t.lang AND a.r = t.r GROUP BY trial), m AS (SELECT avg(shuffled) AS m FROM f) SELECT trial, shuffled, before, real, round((real - before - (m - before)) / nullif(real - before, 0), 6) AS own_share FROM f, m",
    "multi_label_gain": f"WITH {S}, x AS (SELECT y, toxic, (score >= 1000)::INT AS b, (score < 400)::INT AS f FROM scored), t AS (SELECT sum(y * b)::BIGINT AS tp_before, (sum(y * b) + sum(toxic * f))::BIGINT AS tp_after, sum(y + toxic)::BIGINT AS n_gold, sum(b)::BIGINT AS n_before, sum(b + f)::BIGINT AS n_after FROM x) SELECT *, round(tp_before::DOUBLE / n_before, 6) AS precision_before, round(tp_after::DOUBLE / n_after, 6) AS precision_after, round(tp_before::DOUBLE / n_gold, 6) AS recall_before, round(tp_after::DOUBLE / n_gold, 6) AS recall_after FROM t",
    "per_class_agreement": f"WITH {S} SELECT 'quality' AS class, count(*) AS fired, count(*) FILTER (y = 1) AS tp FROM scored WHERE score >= 1000 UNION ALL SELECT 'toxic', count(*), count(*) FILTER (toxic = 1) FROM scored WHERE score < 400",
}
