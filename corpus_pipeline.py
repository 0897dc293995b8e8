"""The corpus pipeline: toxic and poor documents go, one of each group of near copies stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Learning stages take their labels
from ``labels`` in ``sf_dir`` and their texts from ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.llm.common import by_place, place, save
from kymora.llm.packing import pack
from kymora.llm.quality import with_quality
from kymora.llm.queries import vocabulary
from kymora.llm.simhash import near_roots
from kymora.llm.toxicity import with_toxicity
from kymora.session import table

#: A document goes if its toxicity is at least this.
TOXIC_AT = 0.3
#: A document goes if its quality is below this.
QUALITY_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under TOXIC_AT.

    Null and empty texts get the rate of texts without any term among the labelled, long ones are read whole, equal rows
    fare alike, and null ids are scored like others. An empty table gives no rows; columns may have any names.
    """
    scored = with_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < TOXIC_AT).drop("score", "evidence").toDF(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY_FROM.

    Null texts are scored as empty ones, long ones are read whole, equal rows fare alike, and null ids are scored like
    others. An empty table gives no rows; columns may have any names.
    """
    scored = with_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= QUALITY_FROM).drop("score").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by four fifths of their five-word shingles: that of the smallest doc_id, nulls last.

    Of rows of one id the one of the smallest hash stays, and one of equal rows. Null, empty and blank texts are each
    other's copies; long texts are compared whole; null ids are grouped like others. An empty table gives no rows;
    columns may have any names.
    """
    plain = by_place(docs)
    # Rows go by a hash of all they hold, so of equal rows one stays; maps can't be hashed.
    row = F.xxhash64(*[F.col(c) for c, kind in plain.dtypes if "map<" not in kind])
    named = [F.col(f"c{place(docs.columns, n)}").alias(n) for n in ("doc_id", "text")]
    rooted = near_roots(plain.select(*named, row.alias("row")), similarity=0.8, width=5)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias("row"))
    return plain.withColumn("row", row).join(kept, "row", "left_semi").dropDuplicates(["row"]).drop("row").toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents in sequences of 2048 tokens; odd rows as ``pack`` says."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("SimHash near-dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: No SQL says a learned score or this packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = save(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
