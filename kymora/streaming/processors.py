"""The same machines on unbounded streams, and event-time aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kymora.keys import Stream
from kymora.operators.folds import Machine, _plain


def stateful(df: DataFrame, s: Stream, machine: Machine, inputs: list[str], keep: list[str], idle_ms: int | None = None) -> DataFrame:
    """A machine over a streaming DataFrame: the state of a subject lives in the state store between micro-batches.

    Rows of a micro-batch are put in order, so a task holds one subject's rows of one trigger: bound the trigger at the
    source. Rows no later than the subject's last are dropped, as a machine can't go back. With ``idle_ms`` the frame needs
    a watermark on the same time; a subject's state is let go when that passes its last row by so much.
    """
    import pickle

    names = [x.split()[0] for x in machine.outputs.split(", ")]
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), machine.outputs])

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, last = (machine.first, None)
        if state.exists:
            raw, last = state.get
            now = pickle.loads(raw)
        rows = pd.concat(list(frames)).sort_values(s.order)
        if last is not None:
            rows = rows[rows[s.us] > last]
        out = []
        for row in rows[inputs].itertuples(index=False, name=None):
            now, got = machine.step(now, tuple(map(_plain, row)))
            out.append(got)
        if len(rows):
            state.update((pickle.dumps(now), int(rows[s.us].max())))
        if idle_ms is not None and state.exists:
            state.setTimeoutTimestamp(max(int(state.get[1]) // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.concat([rows[keep].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return df.groupBy(*s.subject).applyInPandasWithState(run, schema, "state binary, last long", "append", timeout)


def with_control(df: DataFrame, control: DataFrame, flag: str) -> DataFrame:
    """Frames and control events as one stream: ``flag`` holds on control rows, which lack the frames' other columns."""
    return df.withColumn(flag, F.lit(False)).unionByName(control.withColumn(flag, F.lit(True)), allowMissingColumns=True)


def telemetry(df: DataFrame, ts: str, value: str, every: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Rows and mean per tumbling window of event time; late rows are dropped by the watermark."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, every)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(df: DataFrame, ts: str, subject: str, gap: str, late: str = "10 seconds") -> DataFrame:
    """Rows per session: runs of rows of a subject no further apart than ``gap``."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(subject, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def fresh(df: DataFrame, ts: str, keys: list[str], late: str = "10 seconds") -> DataFrame:
    """The first row of each key within the watermark: stale frames are skipped."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns its rows, which are the view ``name`` too.

    Executors write each micro-batch as Parquet beside the checkpoint, in a folder of its number, so the driver holds no
    rows, a batch that is run again replaces its own, and a stream that goes on from its checkpoint adds to what is there.
    In mode "complete" a batch replaces the one before.
    """
    spark: SparkSession = df.sparkSession
    rows = f"{checkpoint.rstrip('/')}-rows"
    # A stream without any batch has rows of no number.
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{rows}/none")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/{'all' if mode == 'complete' else n}")

    query = df.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(rows)
    got.createOrReplaceTempView(name)
    return got


def change_only(df: DataFrame, s: Stream, command: str, keep_alive: int) -> DataFrame:
    """Commands worth sending: changes, and repeats after ``keep_alive`` microseconds without one.

    Between two changes the sends fall on a grid from the change on, so no state is needed: a row is sent if it is the
    first in its cell of that grid.
    """
    w = s.plain()
    changed = F.coalesce(F.col(command) != F.lag(command).over(w), F.lit(True))
    df = df.withColumn("__c", changed).withColumn("__at", F.last(F.when(F.col("__c"), F.col(s.us)), ignorenulls=True).over(s.rows()))
    df = df.withColumn("__cell", F.floor((F.col(s.us) - F.col("__at")) / keep_alive))
    df = df.withColumn("__again", F.coalesce(F.col("__cell") != F.lag("__cell").over(w), F.lit(True)))
    return df.where(F.col("__c") | F.col("__again")).drop("__c", "__at", "__cell", "__again")
