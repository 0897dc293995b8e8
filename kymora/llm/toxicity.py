"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the 5-grams of marked words that the examples tie to a class (by log-likelihood ratio over all
candidates' chance level, and by odds): over all words the cosine goes by topic and language, and votes say less. Examples are labelled documents as TF-IDF vectors over those terms, in blocks of
like examples; the index holds each term's postings and its largest weight in each block. A query bounds its cosine
with every block by those weights and opens blocks, best bound first, until no other can hold a nearer example.
Votes weigh by squared cosine and by how many labelled rows an example stands for, and leave-one-out votes of the
examples themselves calibrate the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from kymora.llm.common import beside, chunks, fold_of, labelled_sample, own, ship

WORDS = re.compile(r"\w+")
GRAM = 5
#: Bound of the labelled sample that the examples come from.
MOST = {1: 4096, 0: 12_288}
#: Log-likelihood ratio from which a term is tied to a class.
TIED = 33.0
#: A tied term is at least so many times as frequent in one class as in the other.
ODDS = 4.0
NEIGHBOURS, BLOCK = 16, 64
#: Weight of the prior among the votes.
PRIOR = 0.05
#: Words kept by a worker before its cache starts anew.
CACHE = 400_000
EVIDENCE = ArrayType(StructType([StructField("doc_id", LongType()), StructField("similarity", DoubleType()), StructField("toxic", IntegerType())]))


def terms_of(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked} | {marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic documents, other documents) of this task's examples."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            counts[y].update(set().union(*map(terms_of, set(WORDS.findall((text or "").lower())))))
    names = list(counts[0] | counts[1])
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([counts[y][t] for t in some], pa.int64()) for y in (1, 0))], names=["term", "a", "b"])


def select_terms(sample: DataFrame, n: dict[int, int]) -> list[str]:
    """All terms tied to a class by the log-likelihood ratio of their document counts; the bounded sample bounds them."""
    pos, neg = float(n.get(1, 0)), float(n.get(0, 0))
    if not pos or not neg:
        return []
    rate = lambda k, total, p: k * F.log(F.greatest(p, F.lit(1e-12))) + (total - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    both = (a + b) / (pos + neg)
    ratio = 2 * (rate(a, pos, a / pos) + rate(b, neg, b / neg) - rate(a, pos, both) - rate(b, neg, both))
    counted = sample.select("text", "y").mapInArrow(_count_terms, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.abs(F.log((a + 0.5) / (b + 0.5) * (neg / pos)))
    tied = counted.withColumn("ratio", ratio).where((F.col("ratio") >= TIED) & (odds >= math.log(ODDS)))
    return [r["term"] for r in tied.orderBy(F.desc("ratio"), "term").select("term").collect()]


class Reader(dict):
    """Numbers of the selected terms in a word; a dictionary that fills itself."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
        if len(self) > CACHE:
            self.clear()
        self[word] = got
        return got

    def counts(self, text: str) -> Counter:
        return Counter(t for got in map(self.__getitem__, WORDS.findall(text.lower())) if got for t in got)


_readers: dict[int, Reader] = {}


def reader(terms: list[str]) -> Reader:
    """This worker's reader for these terms."""
    key = hash(tuple(terms))
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader({t: i for i, t in enumerate(terms)})
    return _readers[key]


def _vectors(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    read = reader(terms)
    for batch in batches:
        got = [read.counts(t or "") for t in batch.column("text").to_pylist()]
        arrays = [batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array([list(c) for c in got], pa.list_(pa.int32())), pa.array([list(c.values()) for c in got], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "y", "terms", "tf"])


class Index:
    """Block-max inverted index of unit TF-IDF vectors."""

    def __init__(self, ids: list[int], labels: list[int], rows: list[dict[int, int]], weights: dict[int, float], n_terms: int):
        n = len(rows)
        df = np.zeros(n_terms)
        for c in rows:
            df[list(c)] += 1
        self.idf = np.log((n + 1) / np.maximum(df, 0.5))
        units = [self.unit(c) for c in rows]
        # Like examples together: blocks are tight where neighbours share their heaviest term.
        order = sorted(range(n), key=lambda i: (int(units[i][0][np.argmax(units[i][1])]), labels[i], ids[i]))
        self.ids, self.labels = np.array([ids[i] for i in order], np.int64), np.array([labels[i] for i in order], np.int32)
        self.weights = np.array([weights[labels[i]] for i in order])
        terms = np.concatenate([units[i][0] for i in order])
        values = np.concatenate([units[i][1] for i in order])
        row = np.repeat(np.arange(n), [len(units[i][0]) for i in order])
        key = (row // BLOCK) * n_terms + terms
        by = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[by], return_index=True)
        self.ends = np.append(first, len(by)).astype(np.int64)
        self.row, self.value = row[by].astype(np.int32), values[by]
        self.most = np.zeros((n_terms, -(-n // BLOCK)), np.float32)
        np.maximum.at(self.most, (terms, row // BLOCK), np.nextafter(values.astype(np.float32), np.float32(2)))
        self.n_terms = n_terms

    def unit(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(counts, np.int64, len(counts))
        tf = np.fromiter(counts.values(), float, len(counts))
        w = (1 + np.log(tf)) * self.idf[terms]
        return terms, w / max(np.sqrt(np.square(w).sum()), 1e-12)

    def nearest(self, counts: dict[int, int], k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example rows, cosines) of the k nearest with a cosine over zero, ties to the earlier row."""
        terms, w = self.unit(counts)
        bound = w @ self.most[terms] * (1 + 1e-6)
        order = np.argsort(-bound, kind="stable")
        rows, cosines = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 4
        while at < len(order) and bound[order[at]] > 0 and not (len(rows) >= k and cosines[k - 1] > bound[order[at]]):
            blocks = order[at : at + step]
            at, step = at + step, 2 * step
            key = (blocks[:, None] * self.n_terms + terms[None, :]).ravel()
            hit = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[hit] == key
            hit, weight = hit[ok], np.tile(w, len(blocks))[ok]
            size = self.ends[hit + 1] - self.ends[hit]
            ends = np.cumsum(size)
            where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[hit] - ends + size, size)
            # One slot per row of the opened blocks, not of the whole index.
            slot = np.empty(len(self.most[0]), np.int64)
            slot[blocks] = np.arange(len(blocks))
            r = self.row[where].astype(np.int64)
            local = np.bincount(slot[r // BLOCK] * BLOCK + r % BLOCK, self.value[where] * np.repeat(weight, size), minlength=len(blocks) * BLOCK)
            found = np.flatnonzero(local > 0)
            more = blocks[found // BLOCK] * BLOCK + found % BLOCK
            keep = self.ids[more] != without if without is not None else np.ones(len(more), bool)
            rows, cosines = np.concatenate([rows, more[keep]]), np.concatenate([cosines, local[found][keep]])
            best = np.lexsort((rows, -cosines))[:k]
            rows, cosines = rows[best], cosines[best]
        return rows, cosines


def calibrate(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising step function from votes to rates by pooling adjacent violators: (lowest vote, rate) of each step."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, t, w in zip(votes[order], y[order], weight[order]):
        pools.append([v, t * w, w])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    # Half a row of each class keeps a pure step off 0 and 1.
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


class Model:
    """Terms, index and calibration; ``base`` is the score of a text that holds no term."""

    def __init__(self, terms: list[str], examples: list[tuple[int, int, dict[int, int]]], rows: dict[int, int]):
        n = Counter(y for _, y, _ in examples)
        stands = {y: rows[y] / n[y] for y in n}
        total = sum(rows.values())
        self.prior = rows.get(1, 0) / total if total else 0.0
        bare = Counter(y for _, y, c in examples if not c)
        weight = {y: bare[y] * stands[y] for y in n}
        self.base = (weight.get(1, 0) + self.prior) / (sum(weight.values()) + 1)
        self.terms, self.index, self.steps = terms, None, None
        full = sorted((e for e in examples if e[2]), key=lambda e: (e[0], e[1]))
        if full:
            self.index = Index([e[0] for e in full], [e[1] for e in full], [e[2] for e in full], stands, len(terms))
            votes = np.array([self.vote(c, without=i)[0] for i, _, c in full])
            self.steps = calibrate(votes, np.array([e[1] for e in full], float), np.array([stands[e[1]] for e in full]))

    def vote(self, counts: dict[int, int], without: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        rows, cosines = self.index.nearest(counts, NEIGHBOURS, without)
        w = np.square(cosines) * self.index.weights[rows]
        mean = self.index.weights.mean()
        return float((w @ self.index.labels[rows] + PRIOR * mean * self.prior) / (w.sum() + PRIOR * mean)), rows, cosines

    def score(self, counts: dict[int, int]) -> tuple[float, list[dict]]:
        if not counts or self.index is None:
            return self.base, []
        vote, rows, cosines = self.vote(counts)
        at = max(0, int(np.searchsorted(self.steps[0], vote, side="right")) - 1)
        seen = [{"doc_id": int(self.index.ids[r]), "similarity": float(c), "toxic": int(self.index.labels[r])} for r, c in zip(rows[:3], cosines[:3])]
        return float(self.steps[1][at]), seen


def train(docs: DataFrame, labels: DataFrame, is_training, most: dict[int, int] = MOST) -> Model:
    """Learns from labelled rows that ``is_training`` marks; the sample, its terms and its vectors are bounded."""
    sample, rows = labelled_sample(docs, labels, "toxic", is_training, most)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    terms = select_terms(sample, n)
    got = sample.mapInArrow(lambda b: _vectors(b, terms), "doc_id long, y int, terms array<int>, tf array<int>").collect()
    return Model(terms, [(r["doc_id"], r["y"], dict(zip(r["terms"], r["tf"]))) for r in got], {y: rows[y] for y in n})


def _score(batches: Iterator[pa.RecordBatch], at: int, model) -> Iterator[pa.RecordBatch]:
    """The batches with score and evidence after their own columns."""
    model = model.value
    read = reader(model.terms)
    seen: dict[tuple, tuple[float, list[dict]]] = {}
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    for batch in chunks(batches, at):
        got = []
        for text in pc.fill_null(batch.column(at), "").to_pylist():
            counts = read.counts(text)
            key = tuple(sorted(counts.items()))
            if key not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                seen[key] = model.score(dict(key))
            got.append(seen[key])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], kind)],
            names=[*batch.schema.names, "score", "evidence"],
        )


def with_toxicity(docs: DataFrame, labels: DataFrame, is_training=None) -> DataFrame:
    """All columns of ``docs`` by place (c0, c1, ...), score and evidence: one pass over the rows, no join.

    Odd rows and labels are as ``toxicity_scores`` says; columns may have any names, ``doc_id`` and ``text`` among them.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, fold_of("doc_id", 4) != 2 if is_training is None else is_training))
    return beside(docs, lambda batches, at: _score(batches, at, model), StructField("score", DoubleType()), StructField("evidence", EVIDENCE))


def toxicity_scores(docs: DataFrame, labels: DataFrame, is_training=None, threshold: float = 0.3) -> DataFrame:
    """Scores every text of ``docs`` (doc_id, text): doc_id, score, predicted, evidence (the nearest three examples).

    Learns from ``labels`` (doc_id, toxic) where ``is_training`` holds; by default ids whose crc32 modulo 4 is not 2.
    Null and empty texts, and texts without any term, get the rate of such texts among the labelled. Without labels, or
    with one class only, every text gets the rate of the labels (0 without any); of several labels of one id the largest
    counts. Long texts are read whole; of equally near examples the one of the smaller id in the index's order counts.
    Null ids and repeated rows are scored like others; an empty table gives no rows; further columns are ignored,
    whatever their names.
    """
    scored = with_toxicity(own(docs, "doc_id", "text"), labels, is_training)
    return scored.select(F.col("c0").cast("bigint").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
