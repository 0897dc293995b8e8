"""Evaluation of scores against 0/1 labels, per optional group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, y: str, score: str, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(y) == 1
    got = df.groupBy(*keys).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return got.withColumns({
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
    })


def by_threshold(df: DataFrame, y: str, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct score: positives and negatives at it; the ranking metrics work on these rows."""
    return df.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("n"))


def running(d: DataFrame, keys: tuple[str, ...], order: str, sums: dict[str, str], parts: int = 128) -> DataFrame:
    """``d`` with running sums, each row's own included, in ascending ``order`` (distinct within keys): ``{column: name of its sum}``.

    Rows lie in ``parts`` ranges of ``order``; one row per range gives the sums before it, so no window spans a key.
    """
    cuts = sorted(set(d.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0] or []))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    d = d.withColumn("__part", place)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    totals = totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    within = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "__part")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    got = d.withColumns({f"__in_{c}": F.sum(c).over(within) for c in sums}).alias("l").join(totals.alias("r"), on)
    return got.select(*[F.col(f"l.{c}") for c in d.columns if c != "__part"], *[(F.col(f"l.__in_{c}") + F.col(f"r.__{c}")).alias(name) for c, name in sums.items()])


def roc_auc(df: DataFrame, y: str, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half."""
    d = running(by_threshold(df, y, score, keys), keys, "s", {"n": "upto"})
    return d.groupBy(*keys).agg(ratio(F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of recall steps times precision over distinct thresholds, highest first."""
    d = running(by_threshold(df, y, score, keys).withColumn("down", -F.col("s")), keys, "down", {"p": "tp", "n": "fp"})
    return d.groupBy(*keys).agg(ratio(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p")).alias("average_precision"))


def youden(df: DataFrame, y: str, score: str, low: int = 10, high: int = 85) -> DataFrame:
    """The first threshold of low % … high % with the largest sensitivity + specificity - 1.

    Rows are counted once per percent step they pass; the thresholds' counts are running sums over that short histogram.
    """
    # A score passes threshold t/100 where score >= t/100: its step is the number of thresholds that it passes.
    steps = F.array(*[F.lit(t / 100.0) for t in range(low, high + 1)])
    passed = F.size(F.filter(steps, lambda t: F.col(score) >= t))
    hist = df.groupBy(passed.alias("passed")).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    grid = df.sparkSession.range(0, high - low + 2).select(F.col("id").cast("int").alias("passed")).join(hist, "passed", "left").fillna(0)
    up = Window.partitionBy().orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    got = grid.select("passed", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("neg"))
    got = got.where("passed >= 1").select(((F.col("passed") + low - 1) / 100.0).alias("threshold"), ratio(F.col("tp"), F.col("pos")).alias("sensitivity"), (1 - ratio(F.col("fp"), F.col("neg"))).alias("specificity"))
    return got.withColumn("youden", F.col("sensitivity") + F.col("specificity") - 1).orderBy(F.desc(F.round("youden", 12)), "threshold").limit(1)


def cohens_d(df: DataFrame, y: str, features: list[str]) -> DataFrame:
    """|difference of means| over the root of the mean population variance, per feature (feature, d); 0 for tiny variances."""
    long = df.select(y, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("z")).select(y, "z.*")
    got = long.groupBy("feature").agg(*[f(F.when(F.col(y) == c, F.col("v"))).alias(f"{n}{c}") for c in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop))])
    pooled = (F.col("v0") + F.col("v1")) / 2
    return got.select("feature", F.when(pooled > 1e-6, F.abs(F.col("m1") - F.col("m0")) / F.sqrt(pooled)).otherwise(0.0).alias("d"))


def fold_plan(kinds: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int, int, int]]:
    """Folds of whole groups that keep the classes' shares even: greedy, most uneven groups first.

    ``kinds`` has (negatives, positives, number of such groups); groups of one kind are alike, so the plan says how many of
    them go where: (negatives, positives, fold, from, to). Raises if a fold would lack a class.
    """
    k = min(k, sum(m for *_, m in kinds))
    totals = [max(1, sum(kind[i] * kind[2] for kind in kinds)) for i in (0, 1)]
    folds, plan = [[0, 0] for _ in range(k)], []
    for n, p, m in sorted(kinds, key=lambda x: (-abs(x[0] - x[1]), -x[0] - x[1], x)):
        taken = [0] * k
        for _ in range(m):
            def spread(j: int, n=n, p=p) -> tuple[float, int]:
                cost = 0.0
                for c, total, add in ((0, totals[0], n), (1, totals[1], p)):
                    shares = [(f[c] + (add if i == j else 0)) / total for i, f in enumerate(folds)]
                    mean = sum(shares) / k
                    cost += (sum((s - mean) ** 2 for s in shares) / k) ** 0.5
                return cost, sum(folds[j])

            j = min(range(k), key=spread)
            taken[j] += 1
            folds[j][0] += n
            folds[j][1] += p
        at = 0
        for j, some in enumerate(taken):
            if some:
                plan.append((n, p, j, at, at + some))
            at += some
    if any(0 in f for f in folds):
        raise ValueError("a validation fold holds one class only")
    return plan


def group_folds(df: DataFrame, y: str, group: str, k: int) -> DataFrame:
    """(group, fold) by ``fold_plan``: only the distinct pairs of class counts come to the driver, never the groups."""
    counts = df.groupBy(group).agg(F.count_if(F.col(y) == 0).alias("__n"), F.count_if(F.col(y) == 1).alias("__p"))
    kinds = [tuple(r) for r in counts.groupBy("__n", "__p").count().collect()]
    plan = df.sparkSession.createDataFrame(fold_plan(kinds, k), "__n long, __p long, fold int, __from long, __to long")
    nth = F.row_number().over(Window.partitionBy("__n", "__p").orderBy(F.xxhash64(group), group)) - 1
    placed = counts.withColumn("__i", nth).join(F.broadcast(plan), ["__n", "__p"])  # a row per kind and fold at most
    return placed.where((F.col("__i") >= F.col("__from")) & (F.col("__i") < F.col("__to"))).select(group, "fold")


def downsample_by_subject(df: DataFrame, y: str, subject: str, row_id: str, above: float = 1.5, to: float = 1.25, seed: int = 42) -> DataFrame:
    """The larger class 0 cut to ``to`` times class 1, each subject in proportion and with one row at least.

    Rows are drawn by a hash of their id. The quota of a subject is its share rounded half to even.
    """
    whole = Window.partitionBy()
    sizes = df.groupBy(subject).agg(F.count_if(F.col(y) == 0).alias("__n"), F.count_if(F.col(y) == 1).alias("__p"))
    sizes = sizes.withColumns({"__neg": F.sum("__n").over(whole), "__pos": F.sum("__p").over(whole)})
    share = F.greatest(F.lit(1), F.bround(F.floor(to * F.col("__pos")) * F.col("__n") / F.col("__neg")).cast("bigint"))
    quota = F.when(F.col("__neg") > above * F.col("__pos"), F.least(F.col("__n"), share)).otherwise(F.col("__n"))
    w = Window.partitionBy(subject, y).orderBy(F.xxhash64(F.lit(seed), row_id), row_id)
    got = df.join(sizes.select(subject, quota.alias("__q")), subject).withColumn("__i", F.row_number().over(w))
    return got.where((F.col(y) == 1) | (F.col("__i") <= F.col("__q"))).drop("__q", "__i")
