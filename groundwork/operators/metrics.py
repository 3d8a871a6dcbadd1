"""Ranking and classification metrics by windows and sums; undefined ones are null.

`by` names the grouping columns. Ranks are computed over the distinct scores of a group, not its rows, so a
group may hold most rows: rows are counted for each score first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at_scores(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Per group and distinct score: positives p, negatives q, and running sums down to that score tp, fp."""
    at = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    w = Window.partitionBy(*by).orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("tp", F.sum("p").over(w)).withColumn("fp", F.sum("q").over(w))


def ranking(df: DataFrame, by: Sequence[str], label: str = "hallucinated", score: str = "risk") -> DataFrame:
    """Per group: n, positives, roc_auc (ties count half) and average_precision (steps at distinct scores);
    both null unless both classes are there."""
    at = _at_scores(df, by, label, score)
    g = at.groupBy(*by).agg(F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("positives"), F.sum("q").alias("neg"), F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"))
    ok = (F.col("positives") > 0) & (F.col("neg") > 0)
    return g.select(*by, "n", "positives", F.when(ok, F.col("area") / (F.col("positives") * F.col("neg"))).alias("roc_auc"), F.when(ok, F.col("steps") / F.col("positives")).alias("average_precision"))


def untied_auroc(df: DataFrame, by: Sequence[str], tiebreak: str, label: str = "hallucinated", score: str = "risk") -> DataFrame:
    """Area under the row-by-row ROC steps, by falling score and then `tiebreak`; rounded to 3 digits."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tiebreak))
    rows = df.filter(F.col(score).isNotNull()).withColumn("tp", F.sum(F.col(label).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy(*by).agg(F.sum(F.when(F.col(label) == 0, F.col("tp"))).alias("area"), F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    return g.select(*by, F.bround(F.try_divide(F.col("area").cast("double"), (F.col("p") * (F.col("n") - F.col("p"))).cast("double")), 3).alias("auroc"))


def roc_points(df: DataFrame, by: Sequence[str], tiebreak: str, label: str = "hallucinated", score: str = "risk") -> DataFrame:
    """(by, step, fpr, tpr), one point for each row after (0, 0); nulls where a class is missing."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tiebreak))
    run, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    y = F.col(label).cast("long")
    rows = df.filter(F.col(score).isNotNull()).select(*by, F.row_number().over(w).alias("step"), F.sum(y).over(run).alias("tp"), F.sum(1 - y).over(run).alias("fp"), F.sum(y).over(all_).alias("p"), F.sum(1 - y).over(all_).alias("q"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    first = rows.filter("step = 1").select(*by, F.lit(0).alias("step"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return first.unionByName(rows.select(*by, "step", share("fp", "q").alias("fpr"), share("tp", "p").alias("tpr")))


def pr_points(df: DataFrame, by: Sequence[str], tiebreak: str, label: str = "hallucinated", score: str = "risk") -> DataFrame:
    """(by, step, recall, precision), one point for each row after (0, 1)."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tiebreak))
    y = F.col(label).cast("long")
    rows = df.filter(F.col(score).isNotNull()).select(*by, F.row_number().over(w).alias("step"), F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"), F.sum(y).over(Window.partitionBy(*by)).alias("p"))
    first = rows.filter("step = 1").select(*by, F.lit(0).alias("step"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return first.unionByName(rows.select(*by, "step", F.try_divide(F.col("tp").cast("double"), F.col("p").cast("double")).alias("recall"), (F.col("tp") / F.col("step")).alias("precision")))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = over(tp, tp + fp), over(tp, tp + fn)
    return p, r, over(2 * p * r, p + r)


def confusion(df: DataFrame, by: Sequence[str], label: str = "hallucinated", predicted: str = "prediction") -> DataFrame:
    """Per group: tp, fp, fn, tn, accuracy, balanced_accuracy, precision, recall, f1."""
    y, z = F.col(label) == 1, F.col(predicted) == 1
    g = df.filter(F.col(predicted).isNotNull()).groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", y & z), ("fp", ~y & z), ("fn", y & ~z), ("tn", ~y & ~z))])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    specific = F.try_divide(F.col("tn").cast("double"), (F.col("tn") + F.col("fp")).cast("double"))
    sensitive = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    balanced = F.coalesce((specific + sensitive) / 2, specific, sensitive)
    accuracy = F.try_divide((F.col("tp") + F.col("tn")).cast("double"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("double"))
    return g.select(*by, "tp", "fp", "fn", "tn", accuracy.alias("accuracy"), balanced.alias("balanced_accuracy"), p.alias("precision"), r.alias("recall"), f.alias("f1"))


def task_metrics(predictions: DataFrame, by: Sequence[str] = ("task_type",)) -> DataFrame:
    """n_samples, n_predicted, coverage, hallucination_rate, and, where both classes are predicted, all ranking
    and classification metrics; null otherwise."""
    by = list(by)
    base = predictions.groupBy(*by).agg(F.count("*").alias("n_samples"), F.count("risk_score").alias("n_predicted"), F.avg(F.col("risk_score").isNotNull().cast("double")).alias("coverage"), F.avg(F.col("hallucinated").cast("double")).alias("hallucination_rate"))
    rank = ranking(predictions, by, score="risk_score").drop("n", "positives").withColumnRenamed("average_precision", "pr_auc")
    conf = confusion(predictions, by).drop("tp", "fp", "fn", "tn")
    out = base.join(rank, by, "left").join(conf, by, "left")
    names = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")
    return out.withColumns({n: F.when(F.col("roc_auc").isNotNull(), F.col(n)) for n in names})


def best_f1_threshold(df: DataFrame, by: Sequence[str], label: str = "hallucinated", score: str = "risk") -> DataFrame:
    """The smallest threshold among 0, 1 and the scores whose rule score >= t has the best F1."""
    bounds = df.filter(F.col(score).isNotNull()).select(*by).distinct().select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("s"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    at = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    at = at.unionByName(bounds).groupBy(*by, "s").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    down, all_ = Window.partitionBy(*by).orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    rows = at.select(*by, "s", F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp"), F.sum("p").over(all_).alias("all"))
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), (F.col("tp") + F.col("fp") + F.col("all")).cast("double")), F.lit(0.0))
    best = rows.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("s")).alias("minus"))).alias("b"))
    return best.select(*by, (-F.col("b.minus") + 0.0).alias("threshold"), F.col("b.f1").alias("f1"))


def histogram(df: DataFrame, by: Sequence[str], score: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(by, bin, n) over equal bins, the last closed; values outside are left out."""
    x = F.col(score)
    number = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(x.between(low, high)).groupBy(*by, number.alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, low, q1, median, q3, high), quartiles by linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), q.alias("q"), F.max(value).alias("high")).select(*by, "n", "low", *[F.col("q")[i].alias(x) for i, x in enumerate(("q1", "median", "q3"))], "high")


def set_prf(predicted: DataFrame, gold: DataFrame, keys: Sequence[str], by: str = "sample_id") -> DataFrame:
    """Per `by` value: tp, fp, fn, precision, recall, f1, exact of two sets of rows."""
    p, g = predicted.select(*keys).distinct().withColumn("in_p", F.lit(1)), gold.select(*keys).distinct().withColumn("in_g", F.lit(1))
    both = p.join(g, list(keys), "full").groupBy(by).agg(F.count_if(F.col("in_p").isNotNull() & F.col("in_g").isNotNull()).alias("tp"), F.count_if(F.col("in_g").isNull()).alias("fp"), F.count_if(F.col("in_p").isNull()).alias("fn"))
    a, b, c = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return both.select(by, "tp", "fp", "fn", a.alias("precision"), b.alias("recall"), c.alias("f1"), ((F.col("fp") == 0) & (F.col("fn") == 0)).cast("int").alias("exact"))


def micro(per_document: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summed tp, fp, fn with their precision, recall, f1, and the share of exact documents."""
    g = per_document.groupBy(*by).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")], F.avg("exact").alias("exact_graph_accuracy"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), "exact_graph_accuracy")


def winner(f1_a: Column, f1_b: Column, tolerance: float, name_a: str = "a", name_b: str = "b") -> Column:
    """b unless a is better by more than the tolerance."""
    return F.when(f1_b >= f1_a - tolerance, name_b).otherwise(name_a)


def in_task_order(df: DataFrame, tasks: Sequence[str], key: str = "task_type") -> DataFrame:
    """df's rows for these tasks in this order, a row of nulls for those it lacks."""
    dim = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tasks)], f"{key} string, task_order int")
    return dim.join(df, key, "left").orderBy("task_order")


def column_means(df: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """The mean of each of these columns by group."""
    return df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def global_report(df: DataFrame, value: str, below: float, by: Sequence[str] = ()) -> DataFrame:
    """n, n_missing, median, mean, n_below and pct_below of a column; missing values are not counted in the rest.
    Medians and means are rounded to one digit, percentages to none, half to even."""
    x = F.col(value)
    low = F.count_if(x < below)
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.bround(F.median(x), 1).alias("median"), F.bround(F.avg(x), 1).alias("mean"), low.alias("n_below"), F.bround(F.try_divide(100 * low, F.count(x)), 0).alias("pct_below"),
    )


def micro_ceiling(per_document: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summed endpoint ceiling of align.endpoint_ceiling's rows: reachable over all gold relations."""
    g = per_document.groupBy(*by).agg(F.sum("n_gold").alias("n_gold"), F.sum("n_reachable").alias("n_reachable"))
    return g.withColumn("ceiling", F.try_divide(F.col("n_reachable").cast("double"), F.col("n_gold").cast("double")))
