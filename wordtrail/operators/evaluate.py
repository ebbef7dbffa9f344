"""Confusion matrix, binary metrics, ROC and precision/recall curves as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wordtrail.operators.scan import PIECE_ROWS, running_sums
from wordtrail.session import cut_lineage


def confusion_matrix(df: DataFrame, truth: str, prediction: str, labels: list[int]) -> DataFrame:
    """One row per true label, one column per label (``pred_<label>``), missing ones 0.

    Predicted labels outside ``labels`` are not shown.
    """
    return df.groupBy(truth).agg(*[
        F.count_if(F.col(prediction).cast("int") == label).alias(f"pred_{label}") for label in labels])


def true_labels(df: DataFrame, truth: str, limit: int = 1000) -> list[int]:
    """Sorted true labels of the data, for :func:`confusion_matrix`; at most ``limit`` of them."""
    found = df.select(truth).filter(F.col(truth).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{truth} has more than {limit} values and is no class label")
    return sorted(int(r[0]) for r in found)


def binary_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row with counts, accuracy, recall and precision of both classes, and f1."""
    t, p = F.col(truth), F.col(prediction)
    counts = df.agg(F.count_if((t == 0) & (p == 0)).alias("true_negatives"),
                    F.count_if((t == 1) & (p == 0)).alias("false_negatives"),
                    F.count_if((t == 1) & (p == 1)).alias("true_positives"),
                    F.count_if((t == 0) & (p == 1)).alias("false_positives"))
    tn, fn, tp, fp = (F.col(c) for c in counts.columns)
    rates = counts.withColumns({
        "accuracy": F.try_divide(tn + tp, tn + fn + tp + fp),
        "recall_0": F.try_divide(tn, tn + fp), "recall_1": F.try_divide(tp, tp + fn),
        "precision_0": F.try_divide(tn, tn + fn), "precision_1": F.try_divide(tp, tp + fp)})
    r, q = F.col("recall_1"), F.col("precision_1")
    return rates.withColumn("f1", F.try_divide(2 * r * q, r + q))


def score_counts(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Positives and negatives per distinct score; ties and repeated scores end here."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))


def _accumulated(counts: DataFrame, descending: bool, piece_rows: int) -> DataFrame:
    """Running positives and negatives along the score, in pieces rather than in one task."""
    order = counts.withColumn("_order", -F.col("score") if descending else F.col("score"))
    sums = {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}
    return running_sums(order, [], ["_order"], sums, piece_rows).drop("_order")


def area_under_roc(df: DataFrame, score: str, truth: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties counting half; one row ``auc``.

    The table is read once; its counts by score are kept in the shared folder.
    """
    counts = _accumulated(cut_lineage(score_counts(df, score, truth)), False, piece_rows)
    below = F.col("cum_neg") - F.col("neg")
    right = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return counts.agg(F.try_divide(right, pairs).alias("auc"))


#: rank error of a sketch of this size: 2.296 / k ** 0.9723, with 99 % certainty
SKETCH_SIZE = 4096


def sketch_error(k: int = SKETCH_SIZE) -> float:
    return 2.296 / k ** 0.9723


def sketched_curve(df: DataFrame, score: str, truth: str, points: int = 500, k: int = SKETCH_SIZE) -> DataFrame:
    """One row ``auc, positives, negatives, curve`` from one pass and two mergeable sketches of a few
    thousand numbers, however large the table.

    ``curve`` has for each of ``points`` even shares of the positives ``recall`` and ``fpr``, right to
    ``sketch_error(k)`` each and, the latter, a point's width; the area is right to twice that error
    and a point's width. Ties count half. A class without rows gives null.
    """
    value = F.col(score).cast("double")
    made = df.agg(*[F.kll_sketch_agg_double(F.when(F.col(truth) == y, value), F.lit(k)).alias(n) for n, y in (("_pos", 1), ("_neg", 0))],
                  F.count(F.when(F.col(truth) == 1, value)).alias("positives"), F.count(F.when(F.col(truth) == 0, value)).alias("negatives"))
    shares = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    cut = made.filter(both).select("positives", "negatives", *[F.kll_sketch_get_quantile_double(n, shares).alias(n) for n in ("_pos", "_neg")])
    cut = cut.unionByName(made.filter(~both).select("positives", "negatives", *[F.lit(None).cast("array<double>").alias(n) for n in ("_pos", "_neg")]))

    def passed(value: Column) -> Column:
        return (F.size(F.filter("_neg", lambda x: x > value)) + F.size(F.filter("_neg", lambda x: x == value)) / 2) / points

    curve = F.transform("_pos", lambda value, i: F.struct((1 - (i + 0.5) / points).alias("recall"), passed(value).alias("fpr")))
    found = cut.select("positives", "negatives", curve.alias("curve"))
    area = F.aggregate("curve", F.lit(0.0), lambda a, p: a + 1 - p.fpr) / points
    return found.select(area.alias("auc"), "positives", "negatives", "curve")


def curve_points(df: DataFrame, score: str, truth: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per distinct threshold: ``score, fpr, recall, precision``; the table is read once."""
    counts = cut_lineage(score_counts(df, score, truth))
    totals = counts.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).alias("totals")).scalar()
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return _accumulated(counts, True, piece_rows).select(
        "score", F.try_divide(fp, totals.neg).alias("fpr"), F.try_divide(tp, totals.pos).alias("recall"),
        F.try_divide(tp, tp + fp).alias("precision"))
