"""Session settings that the library's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE picks partition counts, splits skewed joins and turns small shuffled sides into broadcasts at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "kymora", **conf: str) -> SparkSession:
    """A session with SETTINGS and further settings by their dotted names (``**{"spark.x": "y"}``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables in ``sf_dir``; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """A stream's checkpoint folder under ``spark.checkpoint.dir``; a local one only where that is unset and all runs in this process."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='kymora-stream-')).rstrip('/')}/{name}"
