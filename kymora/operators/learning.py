"""Grouped cross-validation of boosted trees, calibration and augmentation on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.operators.metrics import group_folds


def assign_folds(df: DataFrame, y: str, group: str, k: int) -> DataFrame:
    """``df`` with the fold of its group; raises where a fold would hold one class only."""
    return df.join(group_folds(df, y, group, k), group)


def _boosted(data: DataFrame, y: str, rounds: int, depth: int, rate: float, seed: int):
    return GBTClassifier(featuresCol="__x", labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=20, seed=seed).fit(data)


def _margins(model, data: DataFrame) -> DataFrame:
    raw = model.transform(data).withColumn("__s", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")
    return VectorAssembler(inputCols=["__s"], outputCol="__v").transform(raw)


def calibrated(train: DataFrame, y: str, group: str, rounds: int, depth: int, rate: float, seed: int, inner: int = 3):
    """(trees, sigmoid): the sigmoid is fitted to margins of rows whose groups their trees had not seen.

    Where ``inner`` folds of whole groups would lack a class, two are tried, and then there is no sigmoid.
    """
    trees = _boosted(train, y, rounds, depth, rate, seed)
    for k in range(inner, 1, -1):
        try:
            folds = assign_folds(train.drop("fold"), y, group, k).cache()
        except ValueError:
            continue
        parts = [_margins(_boosted(folds.where(F.col("fold") != j), y, rounds, depth, rate, seed), folds.where(F.col("fold") == j)) for j in range(k)]
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        sigmoid = LogisticRegression(featuresCol="__v", labelCol=y).fit(seen)
        folds.unpersist()
        return trees, sigmoid
    return trees, None


def mean_importance(models: list, features: list[str]) -> list[tuple[str, float]]:
    """Mean importance of each feature over models, largest first."""
    total = [sum(float(m.featureImportances[i]) for m in models) / max(1, len(models)) for i in range(len(features))]
    return sorted(zip(features, total, strict=True), key=lambda x: (-x[1], x[0]))


def out_of_fold(df: DataFrame, features: list[str], y: str, group: str, k: int = 5, rounds: int = 100, depth: int = 4, rate: float = 0.05, seed: int = 42, models: list | None = None) -> DataFrame:
    """Every row scored by a model that saw none of its group: the columns of ``df``, fold and a calibrated score.

    ``models``, a list, gets the trees of each fold.
    """
    data = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(assign_folds(df, y, group, k)).cache()
    parts = []
    for fold in [r["fold"] for r in data.select("fold").distinct().orderBy("fold").collect()]:
        trees, sigmoid = calibrated(data.where(F.col("fold") != fold), y, group, rounds, depth, rate, seed)
        if models is not None:
            models.append(trees)
        test = _margins(trees, data.where(F.col("fold") == fold))
        score = vector_to_array("probability")[1] if sigmoid else 1 / (1 + F.exp(-2 * F.col("__s")))
        parts.append((sigmoid.transform(test) if sigmoid else test).select(*df.columns, "fold", score.alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def augment_minority(df: DataFrame, y: str, features: list[str], row_id: str, below: float = 0.40, noise: float = 0.02, seed: int = 42) -> DataFrame:
    """Rows of the smaller class drawn again, with noise of ``noise`` deviations on features that aren't 0/1, until the classes balance."""
    n = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count("*").alias("n")).collect()}
    small, large = sorted(n, key=n.get)[0], sorted(n, key=n.get)[-1]
    if n[small] / max(1, n[large]) >= below:
        return df.withColumn("synthetic", F.lit(False))
    kinds = df.agg(*[F.stddev_pop(c).alias(f"{c}_s") for c in features], *[F.min(F.col(c).isin(0, 1)).alias(f"{c}_b") for c in features]).first()
    times = (n[large] - n[small]) / n[small]
    extra = df.where(F.col(y) == small).sample(True, times, seed)
    extra = extra.withColumns({c: F.col(c) + F.randn(seed + i) * noise * (kinds[f"{c}_s"] or 0.0) for i, c in enumerate(features) if not kinds[f"{c}_b"]})
    return df.withColumn("synthetic", F.lit(False)).unionByName(extra.withColumn("synthetic", F.lit(True)))


def permutation_importance(df: DataFrame, features: list[str], y: str, score, repeats: int = 3, seed: int = 42) -> DataFrame:
    """Loss of ROC-AUC when a feature's values are dealt anew: (feature, importance), the mean over ``repeats``.

    ``score(df)`` adds a column "score". Within buckets of a bounded size rows are joined to each other by two orders of
    their hashes, so no value is collected; the features are few, and each is one job.
    """
    from pyspark.sql import Window

    from kymora.operators.metrics import roc_auc

    buckets = max(64, -(-df.count() // 65_536))
    df = df.withColumn("__id", F.xxhash64(*df.columns))
    base = roc_auc(score(df), y, "score").first()[0]
    spread = Window.partitionBy(F.pmod("__id", F.lit(buckets)))
    rows = []
    for f in features:
        lost = 0.0
        for k in range(repeats):
            there = df.withColumn("__n", F.row_number().over(spread.orderBy("__id")))
            other = df.select(F.pmod("__id", F.lit(buckets)).alias("__b"), F.row_number().over(spread.orderBy(F.xxhash64("__id", F.lit(seed + k)))).alias("__n"), F.col(f).alias("__v"))
            dealt = there.withColumn("__b", F.pmod("__id", F.lit(buckets))).join(other, ["__b", "__n"]).withColumn(f, F.col("__v")).drop("__b", "__n", "__v")
            lost += base - roc_auc(score(dealt), y, "score").first()[0]
        rows.append((f, lost / repeats))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
