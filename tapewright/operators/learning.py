"""Training sets, metrics and models on Spark: Newton logistic regression, tree ensembles, walk-forward evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators import linear
from tapewright.operators.blocks import Frames, with_halo


def dataset(returns: DataFrame) -> DataFrame:
    """Features of a row and the next row's direction, complete rows only: series, ts, bar_id, x_ret, x_range, x_volume, label."""
    f = Frames()
    d = with_halo(returns, after=1).withColumn("nxt", f.lead("ret")).where("not halo")
    x = d.select("series", "ts", "bar_id", (F.col("ret") * 1000).alias("x_ret"), ((F.col("high") - F.col("low")) / F.col("close") * 1000).alias("x_range"), F.log1p("volume").alias("x_volume"), F.when(F.col("nxt").isNotNull(), (F.col("nxt") > 0).cast("double")).alias("label"))
    return x.na.drop()


def time_split(df: DataFrame, share: float, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows up to the share-quantile of time (within 0.1 %) and those after it."""
    cut = df.agg(F.percentile_approx(F.unix_micros(ts), share, F.lit(1000)).alias("c")).first().c
    return df.where(F.unix_micros(ts) <= cut), df.where(F.unix_micros(ts) > cut)


def standardise(train: DataFrame, test: DataFrame, xs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both scaled by the training rows' means and population deviations."""
    m = train.agg(*[g(c).alias(f"{n}_{c}") for c in xs for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {c: (F.col(c) - (m[f"m_{c}"] or 0.0)) / (m[f"s_{c}"] or 1.0) for c in xs}
    return train.withColumns(z), test.withColumns(z)


def binary_metrics(y: str, p: Column | str) -> dict[str, Column]:
    """accuracy, precision, recall, f1, log_loss, brier and base_brier of probabilities; 0 where undefined."""
    y, p = F.col(y), F.col(p) if isinstance(p, str) else p
    n = lambda c: F.sum(c.cast("int"))
    hat = p >= 0.5
    tp, fp, fn = n(hat & (y == 1)), n(hat & (y == 0)), n(~hat & (y == 1))
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {"accuracy": F.avg((hat == (y == 1)).cast("int")), "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn), "log_loss": -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q)), "brier": F.avg((p - y) * (p - y)), "base_brier": F.avg(y) * (1 - F.avg(y))}


def logistic_scores(train: DataFrame, test: DataFrame, xs: Sequence[str], label: str = "label") -> DataFrame:
    """`test` plus p, by a logistic model of the training rows."""
    a, b = standardise(train, test, xs)
    w = linear.logistic(a, xs, label)
    eta = F.lit(float(w[0]))
    for c, x in zip(w[1:], xs):
        eta = eta + float(c) * F.col(x)
    return b.withColumn("p", 1 / (1 + F.exp(-eta)))


def tree_scores(train: DataFrame, test: DataFrame, xs: Sequence[str], label: str = "label", trees: int = 10, depth: int = 4, seed: int = 42) -> DataFrame:
    """`test` plus p, by a random forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=list(xs), outputCol="_x")
    m = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(v.transform(train))
    return m.transform(v.transform(test)).withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def evaluate_models(df: DataFrame, xs: Sequence[str], share: float = 0.7) -> DataFrame:
    """(model, rows, metrics): each model trained on the earlier rows and measured on the later ones."""
    train, test = time_split(df, share)
    out = None
    for name, scores in (("logistic", logistic_scores), ("forest", tree_scores)):
        r = scores(train, test, xs).agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in binary_metrics("label", "p").items()]).withColumn("model", F.lit(name))
        out = r if out is None else out.union(r)
    return out


def walk_forward(df: DataFrame, xs: Sequence[str], folds: int = 4) -> DataFrame:
    """(fold, rows, metrics): trained on all rows before a fold, measured on the fold."""
    cuts = df.agg(F.percentile_approx(F.unix_micros("ts"), [(i + 1) / (folds + 1) for i in range(folds)], F.lit(1000)).alias("c")).first().c
    out = None
    for k, a in enumerate(cuts):
        b = cuts[k + 1] if k + 1 < folds else (1 << 62)
        u = F.unix_micros("ts")
        r = logistic_scores(df.where(u <= a), df.where((u > a) & (u <= b)), xs).agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in binary_metrics("label", "p").items()]).withColumn("fold", F.lit(k))
        out = r if out is None else out.union(r)
    return out


def permutation_importance(scored, df: DataFrame, xs: Sequence[str], order: str, seed: int = 42) -> DataFrame:  # noqa: ANN001
    """(feature, loss): how much the Brier score worsens when a feature's values are dealt to other rows by hash order."""
    base = scored(df).agg(F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2.0)))).first()[0]
    rows = []
    for x in xs:
        from pyspark.sql import Window

        w = Window.partitionBy(F.pmod(F.xxhash64(order, F.lit(seed)), F.lit(64)))
        mixed = df.withColumn(x, F.lead(x, 1).over(w.orderBy(F.xxhash64(order)))).na.drop(subset=[x])
        rows.append((x, float(scored(mixed).agg(F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2.0)))).first()[0] - base)))
    return df.sparkSession.createDataFrame(rows, "feature string, loss double")
