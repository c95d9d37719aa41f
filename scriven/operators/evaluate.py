"""Evaluation of scores against labels: AUROC, F1 over thresholds, false-positive rates, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Thresholds of the sweep.
THRESHOLDS = list(range(5, 96, 5))


def auroc(scored: DataFrame, *by: str) -> DataFrame:
    """(by..., auroc) of (label 0/1, score): the rank-sum statistic with average ranks of ties; null with one class only.

    Rows are counted by score first, so the window runs over distinct scores.
    """
    keys = [F.col(c) for c in by]
    per = scored.groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    w = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(w), F.lit(0))
    won = per.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    out = won.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*by, T.rounded(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))), 6).alias("auroc"))


def sweep(scored: DataFrame, *by: str) -> DataFrame:
    """(by..., threshold, precision, recall, f1, fpr): scores at or above a threshold count as positive. 19 rows per row, summed on the map side."""
    each = scored.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    hit = F.col("score") >= F.col("threshold")
    counts = each.groupBy(*by, "threshold").agg(
        F.sum((hit & (F.col("label") == 1)).cast("int")).alias("tp"),
        F.sum((hit & (F.col("label") == 0)).cast("int")).alias("fp"),
        F.sum("label").alias("p"),
        F.sum(1 - F.col("label")).alias("n"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, p, n = F.col("tp"), F.col("fp"), F.col("p"), F.col("n")
    return counts.select(
        *by,
        "threshold",
        T.rounded(share(tp, tp + fp), 6).alias("precision"),
        T.rounded(share(tp, p), 6).alias("recall"),
        T.rounded(share(2 * tp, 2 * tp + fp + (p - tp)), 6).alias("f1"),
        T.rounded(share(fp, n), 6).alias("fpr"),
    )


def best_threshold(swept: DataFrame, *by: str) -> DataFrame:
    """(by..., threshold, f1): the best F1, at the lowest threshold that reaches it."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")
    return (swept.groupBy(*by).agg(best) if by else swept.agg(best)).select(*by, "b.threshold", "b.f1")


def with_all(scored: DataFrame, by: str) -> DataFrame:
    """``scored`` twice: under its own ``by`` and under 'all'."""
    return scored.withColumn(by, F.explode(F.array(F.col(by), F.lit("all"))))


def gates(areas: DataFrame, swept: DataFrame, by: str, least_auroc: float = 0.80, most_fpr45: float = 0.40) -> DataFrame:
    """(gate, value, bound, passed): whether the whole evaluation set reaches the least AUROC, and stays below the false-positive rate at 45."""
    a = areas.where(F.col(by) == "all").select(F.lit("auroc").alias("gate"), F.col("auroc").alias("value"), F.lit(least_auroc).alias("bound"), (F.col("auroc") >= least_auroc).alias("passed"))
    f = swept.where((F.col(by) == "all") & (F.col("threshold") == 45))
    return a.unionByName(f.select(F.lit("fpr_at_45").alias("gate"), F.col("fpr").alias("value"), F.lit(most_fpr45).alias("bound"), (F.col("fpr") <= most_fpr45).alias("passed")))
