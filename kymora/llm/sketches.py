"""Document fingerprints: bottom-k sketches of word shingles, in SQL functions only.

A shingle is a word with up to four words before it, so a text has as many shingles as words and even the shortest
texts compare. Words fold case and part at white space. A sketch holds the ``k`` smallest distinct shingle hashes
(48 bits) in ascending order; a text of at most ``k`` distinct shingles is held whole, and all estimates are then exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymora.llm.common import own, range_bounds, range_bucket

WIDTH = 5
K = 128
#: Hex digits of a hash, and the number of hashes there can be.
DIGITS = 12
SPAN = float(1 << (4 * DIGITS))
#: Documents in a range bucket, about.
BUCKET_ROWS = 4096


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of a text's shingles, one for each word, repeats included."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # The words before the first are zeros: each hash covers `width` numbers, read by place, with no copies of slices.
    padded = F.concat(F.array_repeat(F.lit(0).cast("bigint"), width - 1), F.transform(words, lambda w: F.xxhash64(w)))
    one = lambda p, i: F.shiftrightunsigned(F.xxhash64(*[F.get(p, i + j) for j in range(width)]), 64 - 4 * DIGITS)
    places = lambda p: F.when(F.size(p) >= width, F.sequence(F.lit(0), F.size(p) - width)).otherwise(F.array().cast("array<int>"))
    # The outer array of one binds the padded words: an expression inside a lambda would be computed for each element.
    return F.element_at(F.transform(F.array(padded), lambda p: F.transform(places(p), lambda i: one(p, i))), 1)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, width: int = WIDTH, k: int = K) -> Column:
    """The bottom-k sketch of a text (null: empty)."""
    return bottom_k(shingles(F.coalesce(text, F.lit("")), width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles in all shingles of either; 1 for two empty sketches."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.greatest(F.size(union), F.lit(1)))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * SPAN / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds; 1 for an empty ``a``, 0 for an empty ``b`` and another ``a``."""
    common = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / F.greatest(distinct(a, k), F.lit(1.0))))


def as_text(a: Column) -> Column:
    """Hashes as fixed-width hex, joined."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def merged_sketches(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts: (key, sketch).

    Values are made distinct and counted out per key by rank within the key; each part brings at most ``k`` values. Null
    keys are a key like others; a key with null and empty sketches only gets an empty one; repeated parts change nothing;
    an empty table gives no rows; further columns are ignored.
    """
    values = own(parts, key, column).toDF("k", "s").select("k", F.explode_outer("s").alias("h")).distinct()
    low = values.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.col("h").asc_nulls_last())))
    low = low.where(F.col("rank") <= k).groupBy("k").agg(F.sort_array(F.collect_list("h")).alias("s"))
    return low.toDF(key, column)


def with_next(docs: DataFrame, make: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` (doc_id, text) with ``make`` as sketch, and next_text and next_sketch of the next row, the last's being the first.

    Rows are ordered by id, then by a hash of their texts, and dealt by range buckets cut from a quantile sketch of the
    ids, an id of very many rows to several; each bucket is one task and also gets the first row of the next bucket that
    has any, so that no window spans the table and the texts move once.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ids = docs.select("doc_id", "h")
    bounds = range_bounds(ids, "doc_id", max(1, -(-ids.count() // bucket_rows)))
    # The hash as a number from 0 to below 1, ascending as the hash does.
    bucket = range_bucket("doc_id", bounds, (F.shiftright("h", 11) + (1 << 52)) / float(1 << 53))
    # One row per bucket (MAX_PARTS at most): its first row's id and hash, and the bucket before, in a ring.
    firsts = ids.groupBy(bucket.alias("at")).agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("low"))
    before = F.coalesce(F.lag("at").over(Window.orderBy("at")), F.max("at").over(Window.partitionBy()))
    firsts = firsts.select("at", F.col("low.doc_id").alias("first"), F.col("low.h").alias("low"), before.alias("bucket"))
    same = docs["doc_id"].eqNullSafe(firsts["first"]) & (docs["h"] == firsts["low"]) & (bucket == firsts["at"])
    lead = docs.join(F.broadcast(firsts), same).dropDuplicates(["at"]).select("doc_id", "text", "h", "bucket", F.lit(True).alias("guest"))
    home = docs.select("doc_id", "text", "h", bucket.alias("bucket"), F.lit(False).alias("guest"))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "h", "text")
    seen = home.union(lead).repartitionById(len(bounds) + 1, "bucket").withColumn("sketch", make)
    seen = seen.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w))
    return seen.where(~F.col("guest")).drop("guest", "bucket", "h")


def fingerprint_documents(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and of their edited texts.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has its last quarter of code points replaced by the first as many, or all, of the next document's. Null texts are
    empty; empty sketches are each other's equal (1.0) and no other's (0.0); long texts are read whole. Null ids come
    first; equal ids are ordered by a hash of their texts, and of rows alike in both the order is any. A lone row is its
    own next. An empty table gives no rows; further columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = own(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    paired = with_next(docs, sketch(F.col("text"), width, k)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    paired = paired.select("doc_id", "n_chars", edited.alias("edited"), "sketch", "next_sketch")
    paired = paired.withColumn("edited_sketch", sketch(F.col("edited"), width, k))
    return paired.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
