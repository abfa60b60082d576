"""Classification metrics from (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def outcomes(rows: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, tn) for every value among labels or predictions; one pass over the rows."""
    cells = confusion(rows)
    sides = cells.select(F.explode(F.array(F.struct(F.col("label").alias("label"), F.lit("t").alias("s")), F.struct(F.col("prediction").alias("label"), F.lit("p").alias("s")))).alias("x"), "n", (F.col("label") == F.col("prediction")).alias("hit")).select("x.*", "n", "hit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    got = sides.groupBy("label").agg(count(F.col("hit") & (F.col("s") == "t")).alias("tp"), count(~F.col("hit") & (F.col("s") == "p")).alias("fp"), count(~F.col("hit") & (F.col("s") == "t")).alias("fn"))
    total = cells.agg(F.sum("n").alias("all"))
    return got.crossJoin(F.broadcast(total)).select("label", "tp", "fp", "fn", (F.col("all") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(rows: DataFrame, beta: float = 1.0) -> DataFrame:
    """(label, precision, recall, f1): 0 where a division isn't defined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    b2 = beta * beta
    out = outcomes(rows).withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    return out.select("label", "precision", "recall", _ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("f1"), (tp + fn).alias("support"))


def macro(rows: DataFrame) -> DataFrame:
    """Means over classes, and the share of right predictions."""
    m = per_class(rows).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return m.crossJoin(F.broadcast(accuracy(rows)))


def micro(rows: DataFrame) -> DataFrame:
    s = outcomes(rows).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(_ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def weighted(rows: DataFrame) -> DataFrame:
    """Means weighted by the rows of each label."""
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return per_class(rows).agg(mean("precision"), mean("recall"), mean("f1"))


def nan_mean(rows: DataFrame) -> DataFrame:
    """Undefined ratios are left out of the means; accuracy is the mean over classes of (tp + tn) / all."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    each = outcomes(rows).select(p.alias("p"), r.alias("r"), F.try_divide(2 * p * r, p + r).alias("f"), ((tp + tn) / (tp + fp + fn + tn)).alias("a"))
    return each.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"), F.avg("a").alias("accuracy"))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def percent(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[(F.col(c) * 100).alias(c) for c in metrics.columns])


def best(experiments: DataFrame, metrics: list[str], name: str = "model") -> DataFrame:
    """(metric, model, value): the best model by each metric, ties to the smaller name."""
    long = experiments.unpivot([name], metrics, "metric", "value")
    top = long.groupBy("metric").agg(F.max("value").alias("value"))
    return long.join(top, ["metric", "value"]).groupBy("metric", "value").agg(F.min(name).alias(name)).select("metric", name, "value")
