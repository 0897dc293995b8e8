"""Exact nearest neighbours by a block matrix join over int8 products with error bounds.

Queries and candidates are packed into blocks and dealt to the cells of a grid; a cell multiplies its query blocks
with its candidate blocks, quantised to int8, tile by tile. By the Cauchy-Schwarz inequality the inner product lies
within ``|x| |e_y| + |e_x| |y - e_y|`` of the quantised one, where ``e`` is what quantising took away, so each query's
k-th best lower bound rules out all candidates of a lower upper bound. The pairs that survive are computed again in
double precision, added component by component in order, and the cells' lists are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import own, ship

#: Queries and candidates in a cell of the grid, about: bounds a task's memory (at 64 components, 2 and 8 MB).
CELL_QUERIES, CELL_CANDIDATES = 8192, 32_768
#: Rows and columns of a tile, and pairs that are computed again at once.
TILE_QUERIES, TILE_CANDIDATES, PAIRS = 1024, 4096, 1 << 16
PACKED = "cell int, size int, dims int, ids binary, vectors binary"
FOUND = "query_id long, ids array<long>, scores array<double>"


def valid(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _pack(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one cell each: ids and components as bytes. Rows go by id and vector, so those that share an id are spread."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        starts = np.cumsum(sizes) - sizes
        print_ = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if len(flat):
            # Sums of the components' bits, each by its place, wrap; equal vectors give equal sums.
            nth = (np.arange(len(flat)) - np.repeat(starts, sizes)).astype(np.uint64)
            print_ += np.add.reduceat((flat + 0.0).view(np.uint64) * (2 * nth + np.uint64(0xBF58476D1CE4E5B9)), starts) * np.uint64(0x94D049BB133111EB)
        at = (print_ >> np.uint64(33)).astype(np.int64) % cells
        rows = []
        for dims in np.unique(sizes):
            for cell in np.unique(at[sizes == dims]):
                chosen = np.flatnonzero((sizes == dims) & (at == cell))
                vectors = flat[starts[chosen, None] + np.arange(dims)]
                # A row that repeats another of the batch, id and all, adds nothing.
                _, first = np.unique(np.hstack([ids[chosen, None].view("<f8"), vectors]).view(f"V{8 * (dims + 1)}").ravel(), return_index=True)
                first.sort()
                rows.append((int(cell), len(first), int(dims), ids[chosen[first]].tobytes(), vectors[first].tobytes()))
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cell", "size", "dims", "ids", "vectors"])


def _unpack(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(blocks["ids"]), "<i8")
    vectors = np.frombuffer(b"".join(blocks["vectors"]), "<f8").reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], vectors[order]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, held as float32 for the product; scale; length of what is kept; length of what is lost), a bit over."""
    scale = np.abs(x).max(axis=1) / 127
    values = np.rint(x / scale[:, None])
    kept = values * scale[:, None]
    over = 1 + 1e-9
    return values.astype(np.float32), scale, np.sqrt(np.square(kept).sum(axis=1)) * over, np.sqrt(np.square(x - kept).sum(axis=1)) * over + 1e-12 * scale * 127


def exact(queries: np.ndarray, candidates: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, components added in order: equal vectors give equal sums."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        a, b = queries[i[at : at + PAIRS]], candidates[j[at : at + PAIRS]]
        total = np.zeros(len(a))
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
        out[at : at + PAIRS] = total
    return out


def first_of_copies(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Rows that can be among any query's nearest: of equal vectors, those of the ``keep`` smallest distinct ids."""
    _, which = np.unique(np.ascontiguousarray(vectors).view(f"V{8 * vectors.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, which))
    which, sorted_ids = which[order], ids[order]
    group = np.diff(which, prepend=-1) != 0
    new = group | (np.diff(sorted_ids, prepend=sorted_ids[0] - 1) != 0)
    order, group = order[new], group[new]
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
    return np.sort(order[nth < keep])


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[float]]]:
    """Each query's k best of the candidates by (score descending, id ascending), itself left out; a repeated id counts once, with its best score."""
    rows = first_of_copies(ids, vectors + 0.0, k + 1)  # plus zero: the two zeros are one
    ids, vectors = ids[rows], vectors[rows]
    # A query's own id and repeated ids may take places among the best; look that much further.
    deep = k + 1 + len(ids) - len(np.unique(ids))
    values, scale, kept, lost = quantise(vectors)
    q_values, q_scale, q_kept, q_lost = quantise(queries)
    for start in range(0, len(queries), TILE_QUERIES):
        q = slice(start, start + TILE_QUERIES)
        highs: list[np.ndarray] = []
        cut = np.full((len(q_scale[q]), 0), 0.0)
        for at in range(0, len(ids), TILE_CANDIDATES):
            c = slice(at, at + TILE_CANDIDATES)
            # Products of int8 values are whole numbers; float32 holds them up to 2**24, and float64 beyond 1000 components.
            tile = q_values[q] @ values[c].T if values.shape[1] <= 1000 else q_values[q].astype(float) @ values[c].T.astype(float)
            tile = tile * q_scale[q, None] * scale[None, c]
            slack = (q_kept[q] + q_lost[q])[:, None] * lost[None, c] + q_lost[q][:, None] * kept[None, c] + 1e-12 * q_kept[q][:, None] * kept[None, c]
            highs.append(np.nextafter((tile + slack).astype(np.float32), np.float32(np.inf)))
            cut = np.concatenate([cut, tile - slack], axis=1)
            if cut.shape[1] > deep:
                cut = -np.partition(-cut, deep - 1, axis=1)[:, :deep]
        floor = cut.min(axis=1) if cut.shape[1] >= deep else np.full(len(cut), -np.inf)
        for r0 in range(0, len(floor), 64):
            # A few queries at a time: the surviving pairs, their scores, and each query's heap of the best.
            hit = np.concatenate([h[r0 : r0 + 64] for h in highs], axis=1) >= floor[r0 : r0 + 64, None]
            i, j = np.nonzero(hit)
            scores = exact(queries[start + r0 : start + r0 + 64], vectors, i, j)
            bounds = np.searchsorted(i, np.arange(len(hit) + 1))
            for n in range(len(hit)):
                s, t = scores[bounds[n] : bounds[n + 1]], ids[j[bounds[n] : bounds[n + 1]]]
                own_id = query_ids[start + r0 + n]
                order = np.lexsort((t, -s))
                best_ids, best = [], []
                seen = {int(own_id)}
                for o in order.tolist():
                    if int(t[o]) not in seen:
                        seen.add(int(t[o]))
                        best_ids.append(int(t[o]))
                        best.append(float(s[o]))
                        if len(best) == k:
                            break
                yield int(own_id), best_ids, best


def _cell(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    if queries.empty or candidates.empty:
        return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
    rows = list(nearest(*_unpack(queries), *_unpack(candidates), k))
    return pd.DataFrame(rows, columns=["query_id", "ids", "scores"])


def merge_best(lists: Iterator[tuple[list[int], list[float]]], k: int) -> list[tuple[int, float]]:
    """The k best of sorted lists, ties to the smaller id, an id once: a heap holds one entry of each list."""
    out: list[tuple[int, float]] = []
    seen: set[int] = set()
    for negative, i in heapq.merge(*[zip((-s for s in scores), ids) for ids, scores in lists]):
        if i not in seen:
            seen.add(i)
            out.append((i, -negative))
            if len(out) == k:
                break
    return out


def _merge(group: pd.DataFrame, k: int) -> pd.DataFrame:
    best = merge_best(((list(i), list(s)) for i, s in zip(group["ids"], group["scores"])), k)
    ids, scores = [i for i, _ in best], [s for _, s in best]
    return pd.DataFrame({"query_id": group["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": np.array(ids, np.int64), "score": np.array(scores, float)})


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for every row that ``is_query`` marks: query_id, rank, vec_id, score.

    ``is_query`` says it of the id and the vector by their names. All rows but the query's own are candidates. Rows with a null id, and vectors that are null, empty, zero or hold a
    null or non-finite component, take no part; vectors meet only those of as many components. Rows that share an id
    count as one with several vectors: the best product counts. Ties go to the smaller id. Fewer than ``k`` candidates
    are all returned; an empty table, or one without queries, gives no rows; further columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    ship(spark)
    clean = own(rows, id_column, vector_column).select(id_column, vector_column, F.coalesce(is_query, F.lit(False)).alias("__query")).toDF("id", "vector", "query").where(F.col("id").isNotNull() & valid(F.col("vector")))
    n, n_queries = clean.agg(F.count("*"), F.count_if("query")).first()
    spread = int(spark.sparkContext.defaultParallelism)
    r = max(1, -(-n_queries // CELL_QUERIES))
    c = max(1, -(-n // CELL_CANDIDATES), min(spread, -(-n // 2048)))
    left = clean.where("query").select("id", "vector").mapInArrow(lambda b: _pack(b, r), PACKED)
    right = clean.select("id", "vector").mapInArrow(lambda b: _pack(b, c), PACKED)
    left = left.withColumn("r", F.col("cell")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    right = right.withColumn("c", F.col("cell")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    cells = left.groupBy("r", "c", "dims").cogroup(right.groupBy("r", "c", "dims")).applyInPandas(lambda a, b: _cell(a, b, k), FOUND)
    return cells.groupBy("query_id").applyInPandas(lambda g: _merge(g, k), "query_id long, rank int, vec_id long, score double")
