"""Summaries: window statistics, personal baselines, roll-ups and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = ("mean", "std", "min", "max", "p10", "p50", "p90")


def known(x: str | Column) -> Column:
    """NULL for a missing value, never NaN."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), c)


def seven_stats(df: DataFrame, keys: list[str], channels: dict[str, Column]) -> DataFrame:
    """Mean, population deviation, extremes and linear 10/50/90 % quantiles of each channel per key; 0 where all are missing."""
    df = df.select(*keys, *[known(c.cast("double")).alias(f"__{n}") for n, c in channels.items()])
    aggs = []
    for n in channels:
        c = f"__{n}"
        q = F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        aggs += [F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"), F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), q.alias(f"{n}_q")]
    got = df.groupBy(*keys).agg(*aggs)
    out = []
    for n in channels:
        out += [F.coalesce(f"{n}_{s}", F.lit(0.0)).alias(f"{n}_{s}") for s in STATS[:4]]
        out += [F.coalesce(F.get(f"{n}_q", i), F.lit(0.0)).alias(f"{n}_{s}") for i, s in enumerate(STATS[4:])]
    return got.select(*keys, *out)


def derived_ratios(df: DataFrame, channel: str, up: str, down: str) -> DataFrame:
    """Aperture, mean over the top, and one channel's mean over another's, with floors in the denominators."""
    return df.withColumns({
        "aperture_range": F.col(f"{channel}_p90") - F.col(f"{channel}_p10"),
        "normalized_mean": F.col(f"{channel}_mean") / F.greatest(F.col(f"{channel}_p90"), F.lit(0.15)),
        "up_down_ratio": F.col(f"{up}_mean") / F.greatest(F.col(f"{down}_mean"), F.lit(0.10)),
    })


def neutral_where(df: DataFrame, silent: Column, neutral: dict[str, float]) -> DataFrame:
    """Channels of silent groups take their neutral value in every statistic, with deviation 0."""
    cols = {f"{n}_{s}": F.when(silent, 0.0 if s == "std" else v).otherwise(F.col(f"{n}_{s}")) for n, v in neutral.items() for s in STATS}
    return df.withColumns(cols)


def subject_delta(df: DataFrame, subject: str, columns: list[str], q: float = 0.9) -> DataFrame:
    """Columns less their subject's quantile, named ``*_delta_base``: one pass per subject, joined back to its rows."""
    base = df.groupBy(F.col(subject).alias("__of")).agg(*[F.percentile(c, q).alias(f"__{c}") for c in columns])
    got = df.join(base, F.col(subject).eqNullSafe(F.col("__of")))
    return got.withColumns({f"{c}_delta_base": F.col(c) - F.col(f"__{c}") for c in columns}).drop(*columns, "__of", *[f"__{c}" for c in columns])


def conditional_medians(df: DataFrame, subject: str, metrics: dict[str, tuple[Column, Column]], order: list[str], most: int) -> DataFrame:
    """Median of each metric's last ``most`` rows that meet its own condition, with their number: (subject, metric, n_metric …)."""
    df = df.withColumns({f"__{n}": F.when(cond, value.cast("double")) for n, (value, cond) in metrics.items()})
    later = Window.partitionBy(subject).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__{n}": F.when(F.count(f"__{n}").over(later) <= most, F.col(f"__{n}")) for n in metrics})
    aggs = [a for n in metrics for a in (F.percentile(f"__{n}", 0.5).alias(n), F.count(f"__{n}").alias(f"n_{n}"))]
    return df.groupBy(subject).agg(*aggs)


def ingress_guard(df: DataFrame, level: str, speed: str, asym: str, n_speed: str) -> DataFrame:
    """Baselines of an impaired start are reset to the norm; others are clamped into the plausible range."""
    bad = ((F.col(level) < 0.25) & (F.col(speed) < 1.80) & (F.col(n_speed) >= 3)) | (F.col(level) < 0.21) | (F.col(asym) > 0.08)
    clamp = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
    return df.select(
        "*", bad.alias("ingress"), F.when(bad, 0.28).otherwise(clamp(level, 0.25, 0.38)).alias(f"{level}_base"),
        F.when(bad, 2.5).otherwise(clamp(speed, 1.80, 3.20)).alias(f"{speed}_base"), F.least(F.col(asym), F.lit(0.05)).alias(f"{asym}_base"),
    )


def verdict(high: Column, mild: Column, lockouts: Column, valid: Column, risk: Column) -> Column:
    """HIGH from five lockouts or a tenth of rows, MILD from a quarter or mean risk 25; class counts over all rows, divided by the valid ones."""
    n = F.greatest(valid, F.lit(1))
    return (
        F.when((lockouts >= 5) | (high / n >= 0.10), "HIGH_RISK_INTOXICATED").when((mild / n >= 0.25) | (risk >= 25), "MILD_IMPAIRMENT").otherwise("SOBER")
    )


def audit_status(face: Column, ungated: Column, cuts: Column) -> Column:
    return F.when((face < 65) | (ungated < 50), "REJECTED_LOW_FACE").when(cuts >= 2, "WARNING_JUMP_CUTS").otherwise("ACCEPTED")


def balanced_stride(counts: DataFrame, label: str, n: str) -> DataFrame:
    """1.5 s for the larger class, its share of that for a smaller one, half a second at least."""
    top = F.max(n).over(Window.partitionBy())
    return counts.withColumn("stride", F.when(F.col(n) == top, 1.5).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.5), 1.5 * F.col(n) / top))))
