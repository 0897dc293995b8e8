"""Helpers that the corpus operators share: shared-folder tables, shipping of the code, words, prefix sums."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word: a run of anything but the six ASCII white-space characters.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Lower-cases A-Z and nothing else.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Characters of text that one numpy step works on; bounds a Python worker's memory whatever the batch holds.
CHUNK_CHARS = 1 << 20
#: Range buckets of a table at most: what the driver and a broadcast hold of them is bounded, larger buckets spill.
MAX_PARTS = 65_536


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, everything else kept."""
    return text.lower() if text.isascii() else text.translate(LOWER)


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every machine sees; a local one only where none is set and all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="kymora-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/kymora-{tag}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables through Hadoop's file system, wherever they are."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def save(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet into the shared folder and reads it again: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix="kymora-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(name)
    atexit.register(lambda: os.path.exists(name) and os.unlink(name))


# ---------------------------------------------------------------- columns


def place(columns: list[str], name: str) -> int:
    """Place of a column: of the first by that very name, or else of the only one that differs in case alone."""
    if name in columns:
        return columns.index(name)
    found = [i for i, c in enumerate(columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} columns are called {name}")
    return found[0]


def by_place(df: DataFrame) -> DataFrame:
    """Columns named c0, c1, ... by place: no name clashes with another, whatever its case, or with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; further columns, whatever they are called, can't clash with the operator's own."""
    return by_place(df).select(*[F.col(f"c{place(df.columns, n)}").alias(n) for n in names])


def beside(docs: DataFrame, run, *fields: StructField) -> DataFrame:
    """``docs`` with columns by place, and ``fields`` that ``run(batches, place of the text)`` adds to the batches."""
    at, plain = place(docs.columns, "text"), by_place(docs)
    return plain.mapInArrow(lambda batches: run(batches, at), StructType([*plain.schema.fields, *fields]))


def fold_of(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def meet(rows: DataFrame, table: DataFrame, key: str, columns: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` (a null key meets nothing) left-joined to ``columns`` of a table that holds each ``key`` once.

    ``hot`` (key) are the keys of very many rows, of a bounded number: what the table says of them is broadcast, and their
    rows are dealt out by a hash of all they hold, so no key's rows meet in one task.
    """
    said = F.struct(*columns)
    known = F.broadcast(table.join(F.broadcast(hot.select(key)), key, "left_semi").select(F.col(key).alias("__hot"), said.alias("__known")))
    dealt = rows.join(known, F.col(key) == F.col("__hot"), "left").withColumn("__at", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    got = dealt.join(table.select(F.col(key).alias("__at"), said.alias("__got")), "__at", "left").withColumn("__got", F.coalesce("__known", "__got"))
    return got.select(*rows.columns, *[F.col(f"__got.{c}").alias(c) for c in columns])


def offsets(counts: DataFrame, group: list[str], order: str, n: str, out: str) -> DataFrame:
    """Rows before each (group, order) cell: a prefix sum over one row per cell, never over the counted rows."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points of a bigint column (null: the least), from a mergeable quantile sketch.

    A value that holds many of the rows is as many cuts.
    """
    parts = min(parts, MAX_PARTS)
    if parts <= 1:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(_ranked(column), at, max(10_000, 4 * parts)).alias("q")).first()["q"]
    return sorted(got or [])


def _ranked(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(-(1 << 63)))


def range_bucket(column: str, bounds: list[int], salt: Column) -> Column:
    """Index of the range that holds the value, by binary searches written as SQL folds.

    Rows of a value that is several cuts are spread over its ranges by ``salt``, from 0 to below 1; ranges stay ascending.
    """
    if not bounds:
        return F.lit(0)
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    cuts = F.transform(F.split(F.lit(",".join(map(str, bounds))), ","), lambda x: x.cast("bigint"))

    def passed(under):
        take = lambda at, s: F.when((at + s <= len(bounds)) & under(F.get(cuts, at + s - 1)), at + s).otherwise(at)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), take)

    high = passed(lambda cut: cut <= _ranked(column))
    if len(set(bounds)) == len(bounds):
        return high
    low = passed(lambda cut: cut < _ranked(column))
    return F.when(high - low > 1, low + 1 + F.floor(salt * (high - low)).cast("int")).otherwise(high)


# ---------------------------------------------------------------- Arrow


def chunks(batches: Iterator[pa.RecordBatch], text: str | int = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` characters of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Labelled training documents (doc_id, text, y), about ``most[c]`` of class ``c`` at most, and all training rows of each class.

    ``train`` is a condition on doc_id. Rows are chosen by a hash of their id against ``most / rows``, so the choice
    needs no sort, is the same every time, and its size is that of a binomial draw: past ``most`` by a few square roots.
    Labels other than 0 and 1 and null ids are left out; of several labels of one id the largest counts, and of several
    texts the smallest.
    """
    spark = docs.sparkSession
    labels = own(labels, "doc_id", label).withColumnRenamed(label, "y")
    known = labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(train)
    known = known.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    rows = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    want = [(F.col("y") == c) & (share < most[c] / n) for c, n in rows.items() if c in most]
    chosen = known.where(want[0] if len(want) == 1 else want[0] | want[1]) if want else known.limit(0)
    # `chosen` is bounded by `most`, so it is broadcast whatever the input.
    found = own(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample, _ = save(found, f"sample-{label}")
    return sample.repartition(2 * spark.sparkContext.defaultParallelism, "doc_id"), rows
