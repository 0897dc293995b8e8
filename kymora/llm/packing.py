"""Harmonic packing: documents are cut into exact fractions of a sequence and bins take a fixed count of one length.

Every piece has a length from a fixed list (`lengths`): those of which ``capacity // length`` fill a sequence but for
``max_waste`` of it. Pieces of one length form a reciprocal-capacity class, whose bins hold exactly that many pieces,
so a piece's bin and place follow from its number within the class. Workers number their own pieces; one row per
worker and class gives the numbers before them. What is left of each class, less than one bin, is bounded by the
list of lengths alone and is packed first-fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import chunks, offsets, own, save, ship
from kymora.llm.units import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def lengths(capacity: int, max_waste: float) -> np.ndarray:
    """The longest allowed piece for each number of remaining tokens, 0 to capacity."""
    n = np.arange(1, capacity + 1)
    allowed = capacity - capacity // n * n <= max_waste * capacity
    return np.concatenate([[0], np.maximum.accumulate(np.where(allowed, n, 0))])


def cut(tokens: int, table: np.ndarray) -> list[int]:
    """Piece lengths of a document: whole sequences first, then ever smaller allowed lengths."""
    capacity = len(table) - 1
    out = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left:
        out.append(int(table[left]))
        left -= out[-1]
    return out


def first_fit(left: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, nth, bin, offset) of the left pieces, given (length, count), longest first into the first bin with room."""
    bins: list[int] = []
    out = []
    for length, count in sorted(left, reverse=True):
        at = nth = 0
        while nth < count:
            if at == len(bins):
                bins.append(0)
            if capacity - bins[at] >= length:
                out.append((length, nth, at, bins[at]))
                bins[at] += length
                nth += 1
            else:
                at += 1
    return out


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, max_waste: float) -> DataFrame:
    """Tokenises whole texts and cuts them; pieces are numbered per worker and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, table, encode = TaskContext.get().partitionId(), lengths(capacity, max_waste), encoder(vocabulary).encode
        seen = np.zeros(capacity + 1, np.int64)
        for batch in chunks(batches):
            ids = batch.column(0).to_pylist()
            flat, sizes = encode([t or "" for t in batch.column(1).to_pylist()])
            out: list[list] = [[] for _ in range(7)]
            flat = flat.astype("<u4")
            end = np.array([end_id], "<u4").tobytes()
            at = 0
            for doc, n in zip(ids, sizes.tolist(), strict=True):
                raw = flat[at : at + n].tobytes() + end
                at += n
                start = 0
                for size in cut(n + 1, table):
                    for col, v in zip(out, (doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n + 1, part, int(seen[size])), strict=True):
                        col.append(v)
                    seen[size] += 1
                    start += size
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return own(docs, "doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, max_waste: float = 1 / 64) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each token of each
    document, its end id included, lies in exactly one piece; pieces of a sequence lie at gapless offsets from 0.
    Null or empty texts are the end id alone; long ones are cut over as many sequences as they fill. Null ids and repeated
    rows are documents like others. An empty table gives no rows; further columns are ignored, whatever their names. Padding is at most ``max_waste`` of each full bin, and the sequences
    of the left pieces number less than the lengths.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces, _ = save(cut_documents(docs, vocabulary, end_id, capacity, max_waste), "pieces")
    counts, _ = save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    before = offsets(counts, ["length"], "part", "n", "before").select("part", "length", "before")
    # One row per allowed length at most: bounded by the capacity, whatever the input.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    classes, base, left = [], 0, []
    for length, n in sorted(totals.items()):
        per_bin = capacity // length
        classes.append((length, per_bin, n // per_bin, base))
        base += n // per_bin
        left.append((length, n % per_bin))
    fitted = [(length, nth, base + at, offset) for length, nth, at, offset in first_fit(left, capacity)]
    table = spark.createDataFrame(classes, "length long, per_bin long, full long, base long")
    rest = spark.createDataFrame(fitted, "length long, nth_left long, left_sequence long, left_offset long")
    number = F.col("before") + F.col("nth")
    placed = (
        pieces.join(before, ["part", "length"])
        .join(F.broadcast(table), "length")  # at most `capacity` rows
        .withColumn("number", number)
        .withColumn("nth_left", F.col("number") - F.col("full") * F.col("per_bin"))
        .join(F.broadcast(rest), ["length", "nth_left"], "left")  # less than one bin of each length
    )
    in_bin = F.col("nth_left") < 0
    out = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(in_bin, F.col("base") + F.floor(F.col("number") / F.col("per_bin"))).otherwise(F.col("left_sequence")).cast("long").alias("sequence_id"),
        F.when(in_bin, F.col("number") % F.col("per_bin") * F.col("length")).otherwise(F.col("left_offset")).cast("long").alias("offset"),
    )
    return out
