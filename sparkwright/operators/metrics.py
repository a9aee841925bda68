"""Score metrics: ROC curves, two AUROCs, confusion counts, threshold choice, stratified and grouped variants.

Input rows have a score, a label `y` of 0 or 1 and, for what depends on file order, an index `idx`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.operators.ordering import running_totals


def by_score(rows: DataFrame, *keys: str) -> DataFrame:
    """Positives and negatives at each distinct score: what rank statistics need, however many rows tie."""
    return rows.groupBy(*keys, "score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def auroc_rank(rows: DataFrame) -> DataFrame:
    """Mann-Whitney AUROC with mid-ranks; null if a side is empty."""
    ranked = running_totals(by_score(rows), "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def auroc_rank_by(rows: DataFrame, *keys: str) -> DataFrame:
    """auroc_rank within each group."""
    ranked = running_totals(by_score(rows, *keys), "score", ["neg"], by=list(keys))
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def auroc_staircase(rows: DataFrame) -> DataFrame:
    """AUROC of the stepwise curve in order of score (descending) and idx, ties not grouped; 0.5 if a side is empty."""
    ranked = running_totals(by_score(rows), "score", ["pos"], descending=True).select("score", "pos_before")
    # positives before each row among those of its score: ranges of idx split a score that most rows share
    inside = running_totals(rows.select("score", "idx", F.col("y").cast("long").alias("own")), "idx", ["own"], by=["score"])
    # rows of one score meet its total as sums, one row for each score
    sums = inside.groupBy("score").agg(F.sum("own").alias("pos"), F.sum(1 - F.col("own")).alias("neg"), F.sum(F.when(F.col("own") == 0, F.col("own_before"))).alias("inner"))
    won = F.sum(F.col("neg") * F.col("pos_before") + F.coalesce("inner", F.lit(0)))
    return sums.join(ranked, "score").agg(F.coalesce(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")), F.lit(0.5)).alias("auroc"))


def roc_curve(rows: DataFrame) -> DataFrame:
    """(score, tp, fp, tpr, fpr) at each distinct score, from the largest down."""
    ranked = running_totals(by_score(rows), "score", ["pos", "neg"], descending=True)
    total = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    out = ranked.select("score", tp.alias("tp"), fp.alias("fp")).join(F.broadcast(total))  # one row
    return out.select("score", "tp", "fp", F.round(F.try_divide("tp", "p"), 6).alias("tpr"), F.round(F.try_divide("fp", "n"), 6).alias("fpr"))


def thin_curve(curve: DataFrame, n_points: int, most: int = 400) -> DataFrame:
    """A curve with a running number `i` from 0, thinned to each stride-th point; both ends stay."""
    stride = max(1, n_points // most)
    return curve.where((F.col("i") % stride == 0) | (F.col("i") == n_points - 1))


def confusion(rows: DataFrame, threshold) -> DataFrame:
    """Counts and rates of score >= threshold; a rate with nothing below the line is null."""
    hit = F.col("score") >= threshold
    tp, fp = F.count_if(hit & (F.col("y") == 1)), F.count_if(hit & (F.col("y") == 0))
    fn, tn = F.count_if(~hit & (F.col("y") == 1)), F.count_if(~hit & (F.col("y") == 0))
    return rows.agg(tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn")).select("*", *rates())


def rates() -> list:
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    f1 = F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)
    return [ratio("tp", "fn").alias("sens"), ratio("tn", "fp").alias("spec"), ratio("tp", "fp").alias("ppv"), ratio("tn", "fn").alias("npv"), f1.alias("f1")]


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """confusion at each threshold, in one pass: each row adds to the thresholds at or below its score."""
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    each = by_score(rows).select("score", "pos", "neg", F.explode(marks).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    counted = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0))
    out = each.groupBy("threshold").agg(counted("pos", hit).alias("tp"), counted("neg", hit).alias("fp"), counted("neg", ~hit).alias("tn"), counted("pos", ~hit).alias("fn"))
    return out.select("threshold", "tp", "fp", "tn", "fn", *rates())


def best_f1(rows: DataFrame) -> DataFrame:
    """The score with the largest F1 as a threshold, the smallest of equals; 0.5 if there are no rows."""
    ranked = running_totals(by_score(rows), "score", ["pos", "neg"], descending=True)
    total = ranked.agg(F.sum("pos").alias("p"))
    tp = F.col("pos_before") + F.col("pos")
    flagged = tp + F.col("neg_before") + F.col("neg")
    scored = ranked.join(F.broadcast(total)).select("score", F.coalesce(F.try_divide(2 * tp, flagged + F.col("p")), F.lit(0.0)).alias("f1"))
    best = F.min_by("score", F.struct(-F.round("f1", 9), F.col("score")))
    return scored.agg(F.coalesce(best, F.lit(0.5)).alias("threshold"), F.round(F.max("f1"), 6).alias("f1"))


def out_of_fold_thresholds(rows: DataFrame, folds: int) -> DataFrame:
    """For each fold the threshold that is best on the other folds, and the counts it gives on the fold itself.

    Each row is summed once for each fold that it is not in; after that only distinct scores are left.
    """
    others = F.array(*[F.lit(f).cast("long") for f in range(folds)])
    spread = rows.withColumn("target", F.explode(others)).where(F.col("target") != F.col("fold"))
    grouped = by_score(spread, "target")
    ranked = running_totals(grouped, "score", ["pos", "neg"], descending=True, by=["target"])
    total = F.broadcast(grouped.groupBy("target").agg(F.sum("pos").alias("all_pos")))  # one row for each fold
    tp = F.col("pos_before") + F.col("pos")
    f1 = ranked.join(total, "target").withColumn("f1", F.round(F.try_divide(2 * tp, tp + F.col("neg_before") + F.col("neg") + F.col("all_pos")), 9))
    best = f1.groupBy("target").agg(F.min_by("score", F.struct(-F.col("f1"), F.col("score"))).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    own = rows.join(F.broadcast(best), rows["fold"] == best["target"])  # one row for each fold
    return own.groupBy("fold", "threshold").agg(
        F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"),
        F.count_if(~hit & (F.col("y") == 0)).alias("tn"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"),
    )


def auroc_by_negatives(rows: DataFrame, group: str) -> DataFrame:
    """All positives against the negatives of each group: (group, auroc, n_neg, weight); sum(weight * auroc) is the AUROC.

    A negative loses to the positives above it, wherever they come from, so one order of all scores serves every group.
    """
    ranked = running_totals(by_score(rows), "score", ["pos"], descending=True)
    total = F.broadcast(ranked.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")))  # one row
    lost = ranked.select("score", (F.col("pos_before") + F.col("pos") / 2).alias("lost"))
    negatives = rows.where("y = 0").groupBy(group, "score").agg(F.count("*").alias("n"))
    each = negatives.join(lost, "score").groupBy(group).agg(F.sum(F.col("n") * F.col("lost")).alias("won"), F.sum("n").alias("n_neg"))
    each = each.join(total)
    return each.select(group, F.try_divide("won", (F.col("all_pos") * F.col("n_neg")).cast("double")).alias("auroc"), "n_neg", (F.col("n_neg") / F.col("all_neg")).alias("weight"))
