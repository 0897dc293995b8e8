"""Length-delimited binary records of token ids, with masked checksums and an offset index for shuffled reads.

A data file is a run of frames, each ``length u64 | masked crc u32 of it | payload | masked crc u32 of the payload``,
little-endian. A payload is ``flags u8 (1: the id is null, 2: ids are u16, else u32) | doc_id i64 | ids``. Its index file, ``<name>.idx``, has one
``offset u64 | length u64 | ids u64`` entry per frame, so that a reader can fetch frames in any order. Checksums are
CRC-32 rotated right by 15 bits plus a constant, so that a checksum of data that holds checksums stays sound.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kymora.llm.common import chunks, own, range_bounds, range_bucket, save, scratch_path, ship
from kymora.llm.units import encoder

HEAD, TAIL, LEAD, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQQ")
#: Fixed value of the mask.
MASK = 0xA282EAD8
NULL_ID, SHORT_IDS = 1, 2
FILES = "bucket int, nth int, path string, records long, tokens long, bytes long"
#: A data file is closed when it has grown to this size; bounds what a reader holds.
FILE_BYTES = 16 << 20
#: Documents per range bucket, the unit that one task sorts and writes.
BUCKET_ROWS = 16_384


class BadRecord(ValueError):
    """A frame that is cut off or whose checksum doesn't hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + TAIL.pack(masked(size)) + payload + TAIL.pack(masked(payload))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at a position and the position after it."""
    if at + HEAD.size > len(data):
        raise BadRecord(f"cut off at {at}")
    size, crc = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise BadRecord(f"length checksum at {at}")
    start = at + HEAD.size
    payload = data[start : start + size]
    if len(payload) != size or start + size + TAIL.size > len(data):
        raise BadRecord(f"cut off at {at}")
    if masked(payload) != TAIL.unpack_from(data, start + size)[0]:
        raise BadRecord(f"payload checksum at {at}")
    return payload, start + size + TAIL.size


def pack_ids(doc_id: int | None, ids: np.ndarray, short: bool) -> bytes:
    flags = (NULL_ID if doc_id is None else 0) | (SHORT_IDS if short else 0)
    return LEAD.pack(flags, doc_id or 0) + ids.astype("<u2" if short else "<u4").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = LEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if flags & SHORT_IDS else "<u4", offset=LEAD.size)
    return (None if flags & NULL_ID else doc_id), ids


def store(uri: str):
    """Arrow's file system of a folder that all machines see, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """One data file and its index, written as frames come; only the index is held.

    The name is one of its own for each attempt: what a lost attempt wrote is in no list of files.
    """

    def __init__(self, folder: str, bucket: int, nth: int):
        self.files, root = store(folder)
        self.path = f"{root}/{bucket:08d}-{nth:05d}-{uuid.uuid4().hex[:8]}.rec"
        self.bucket, self.nth, self.size, self.tokens, self.index = bucket, nth, 0, 0, bytearray()
        self.data = self.files.open_output_stream(self.path, buffer_size=1 << 20)
        self.records = 0

    def add(self, doc_id: int | None, ids: np.ndarray, short: bool) -> None:
        framed = frame(pack_ids(doc_id, ids, short))
        self.data.write(framed)
        self.index += ENTRY.pack(self.size, len(framed), len(ids))
        self.size, self.tokens, self.records = self.size + len(framed), self.tokens + len(ids), self.records + 1

    def close(self) -> pa.RecordBatch:
        """The file's row in the list of files."""
        self.data.close()
        with self.files.open_output_stream(f"{self.path}.idx") as f:
            f.write(bytes(self.index))
        row = [self.bucket, self.nth, self.path, self.records, self.tokens, self.size]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in FILES.split(", ")])


def _write(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    tokens = encoder(vocabulary)
    short = max(tokens.vocabulary, end_id + 1) <= 1 << 16
    out: Writer | None = None
    for batch in chunks(batches):
        flat, sizes = tokens.encode([t or "" for t in batch.column("text").to_pylist()])
        at = 0
        for bucket, doc, n in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
            if out is None or bucket != out.bucket or out.size >= file_bytes:
                nth = 0
                if out is not None:
                    nth = out.nth + 1 if bucket == out.bucket else 0
                    yield out.close()
                out = Writer(folder, bucket, nth)
            out.add(doc, np.append(flat[at : at + n], np.uint32(end_id)), short)
            at += n
    if out is not None:
        yield out.close()


def write_records(docs: DataFrame, vocabulary: str, end_id: int, folder: str, bucket_rows: int = BUCKET_ROWS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) in ascending doc_id order into record files in ``folder``.

    Returns the list of files (bucket, nth, path, records, tokens, bytes), saved once written: the only files that
    count. Range buckets are cut by a quantile sketch of the ids, so no bucket grows with the table, and each is one task
    that sorts it by itself. Null ids come first; equal ids are ordered by text, but where one id holds several buckets
    its rows are dealt to them at random. Long texts are whole records. An empty table writes no file.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = own(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = docs.count()
    bounds = range_bounds(docs, "doc_id", max(1, -(-rows // bucket_rows)))
    files, root = store(folder)
    files.create_dir(root, recursive=True)
    listed = (
        docs.withColumn("bucket", range_bucket("doc_id", bounds, F.rand(29)))
        .repartitionById(len(bounds) + 1, "bucket")
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(lambda b: _write(b, vocabulary, end_id, folder, file_bytes), FILES)
    )
    return save(listed, "files")[0]


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, _ = store(folder)
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with files.open_input_stream(f"{path}.idx") as f:
                entries = list(ENTRY.iter_unpack(f.read()))
            with files.open_input_file(path) as f:
                data = f.read()
            out: list[list] = [[] for _ in range(4)]
            for offset, size, n_ids in entries:
                payload, end = unframe(data, offset)
                doc, ids = unpack_ids(payload)
                if end != offset + size or len(ids) != n_ids:
                    raise BadRecord(f"{path} and its index differ at {offset}")
                for col, v in zip(out, (doc, start, n_ids, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    col.append(v)
                start += n_ids
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(listed: DataFrame, folder: str) -> DataFrame:
    """Reads listed files back, checking every frame: doc_id, start (ids before it in list order), n_tokens, ids_crc32.

    The list may be any part of what was written, in any order; ``start`` counts the ids of the list as ordered. A null
    id comes back null; equal ids and rows are records of their own; an empty list gives no rows; a damaged frame raises
    BadRecord. Further columns of the list are ignored.
    """
    ship(listed.sparkSession)
    # One row per file: a running sum over the list of files, not over documents.
    w = Window.orderBy("bucket", "nth").rowsBetween(Window.unboundedPreceding, -1)
    spread = own(listed, "bucket", "nth", "path", "tokens").withColumn("start", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    n = max(1, listed.count())
    return spread.repartition(n, "path").mapInArrow(lambda b: _read(b, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(path: str, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one data file in any order of its index, each by one seek; ``path`` is a URI or a local path."""
    files, name = store(path if "://" in path else f"file://{path}")
    with files.open_input_stream(f"{name}.idx") as f:
        entries = list(ENTRY.iter_unpack(f.read()))
    with files.open_input_file(name) as f:
        for i in range(len(entries)) if order is None else order:
            offset, size, _ = entries[i]
            f.seek(offset)
            yield unpack_ids(unframe(f.read(size))[0])


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` as record files and reads them back: doc_id, start, n_tokens, ids_crc32 per document.

    Null or empty texts are the end id alone; long ones are encoded whole; null ids come first; repeated rows are records
    of their own; an empty table gives no rows; further columns are ignored, whatever their names.
    """
    folder = folder or scratch_path(docs.sparkSession, "records")
    return read_records(write_records(docs, vocabulary, end_id, folder), folder)
