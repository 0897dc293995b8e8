"""Joins by time and key: as-of, interval and overlap joins without a cross product, resume and validity filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymora.keys import Stream


def asof(left: DataFrame, right: DataFrame, key: str, us: str, value: str, tolerance: int, out: str, out_us: str = "asof_us") -> DataFrame:
    """Each left row with the last right value of its key at or before its time, no older than ``tolerance`` microseconds.

    Both sides are one sorted stream per key and the value is carried forward: one shuffle, no pairs.
    """
    names = left.columns
    a = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast("bigint").alias("__vt"))
    blank = [F.col(key) if c == key else F.col(us) if c == us else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names]
    b = right.select(*blank, F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(us).alias("__vt"))
    w = Window.partitionBy(key).orderBy(us, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionAll(b)
    both = both.withColumn("__last", F.last(F.when(F.col("__side") == 0, F.struct("__v", "__vt")), ignorenulls=True).over(w)).where("__side = 1")
    fresh = F.col(us) - F.col("__last.__vt") <= tolerance
    return both.select(*names, F.when(fresh, F.col("__last.__v")).alias(out), F.when(fresh, F.col("__last.__vt")).alias(out_us))


def interval(left: DataFrame, right: DataFrame, key: str, us: str, back: int, right_us: str) -> DataFrame:
    """Pairs of one key where the right time lies in (left - back, left].

    Each side is cut into buckets of ``back``; a left row looks into its own bucket and the one before, so the join is on
    equal (key, bucket) and a hot key spreads over its buckets.
    """
    a = left.withColumn("__b", F.explode(F.array(F.floor(F.col(us) / back), F.floor(F.col(us) / back) - 1)))
    b = right.withColumn("__b", F.floor(F.col(right_us) / back))
    near = (F.col(right_us) > F.col(us) - back) & (F.col(right_us) <= F.col(us))
    return a.join(b, [key, "__b"]).where(near).drop("__b")


def overlap(spans: DataFrame, windows: DataFrame, key: str, bucket: int) -> DataFrame:
    """Microseconds of (start, end) spans inside each (lo, hi] window of the key: the window's columns and covered.

    Spans are dealt to the buckets they touch and windows look into theirs; a pair meets once, in the first bucket both touch.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
    names = windows.columns
    a, b = windows.withColumn("__b", cells("lo", "hi")), spans.select(key, "start", "end", cells("start", "end").alias("__b"))
    first = F.greatest(F.floor(F.col("lo") / bucket), F.floor(F.col("start") / bucket))
    part = F.when(F.col("start").isNotNull() & (F.col("__b") == first), F.greatest(F.lit(0), F.least("end", "hi") - F.greatest("start", "lo"))).otherwise(0)
    return a.join(b, [key, "__b"], "left").groupBy(*names).agg(F.coalesce(F.sum(part), F.lit(0)).alias("covered"))


def with_baseline(frames: DataFrame, baselines: DataFrame, key: str, columns: list[str], since: str, us: str) -> DataFrame:
    """Frames with their subject's baselines from the moment they were fixed on; null before and for unknown subjects.

    A left join that the optimiser may broadcast when the baselines prove small; nothing forces it.
    """
    joined = frames.join(baselines, key, "left")
    return joined.withColumns({c: F.when(F.col(us) >= F.col(since), F.col(c)) for c in columns})


def not_done(inputs: DataFrame, manifest: DataFrame, on: list[str]) -> DataFrame:
    """Inputs whose output is not in the manifest yet."""
    return inputs.join(manifest.select(*on), on, "left_anti")


def with_any(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Rows of groups in which any row meets the condition."""
    return df.join(df.where(condition).select(*keys).distinct(), keys, "left_semi")


def union_filled(parts: list[DataFrame], fill: dict[str, float]) -> DataFrame:
    """Union by name over the ordered union of columns; missing ones take their neutral value, or 0."""
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    kinds = {c: p.schema[c].dataType for p in reversed(parts) for c in p.columns}
    full = [p.select(*[F.col(c) if c in p.columns else F.lit(fill.get(c, 0)).cast(kinds[c]).alias(c) for c in names]) for p in parts]
    out = full[0]
    for p in full[1:]:
        out = out.unionByName(p)
    return out
