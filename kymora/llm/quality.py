"""Quality by a generalised additive model with pairwise interactions, boosted in cycles over its features.

Each turn fits one shallow tree to each feature's histogram of gradients and adds it to that feature's lookup table;
then pairs of features that still explain residuals get tables of their own, boosted the same way. A score adds one
entry per table, so a batch of texts is scored by binning and vector additions.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from kymora.llm.common import beside, chunks, fold_of, labelled_sample, own, ship

#: Bound of the labelled sample that the model learns from.
MOST = {0: 8_192, 1: 16_384}
BINS, PAIR_BINS, TURNS, PAIRS, PAIR_TURNS, RATE = 48, 12, 120, 8, 60, 0.15
#: Smallest hessian weight of a leaf, and the penalty on a leaf's value.
LEAF, RIDGE = 4.0, 1.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "upper", "digit", "space", "newline",
    "exclaim", "pipe", "comma", "stop", "marks", "symbols", "high", "upper_words", "top_word", "squeeze", "repeated_lines",
    "line_length", "marked_words", "title_words",
)
_SYMBOLS = b"#$%&*+<=>@[]^_`{}~\\/"
_ASCII = {name: np.array([b in chars for b in range(256)]) for name, chars in {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t", "newline": b"\n", "exclaim": b"!?", "pipe": b"|",
    "comma": b",;", "stop": b".", "marks": b"\"'():-", "symbols": _SYMBOLS, "high": bytes(range(128, 256)),
}.items()}
_CLASSES = np.array(list(_ASCII.values()), float)


def features(text: str) -> list[float]:
    """Numbers that say what a whole text is made of; an empty text has zeros only."""
    data = text.encode("utf-8", "replace")
    words = text.split()
    n, m = len(data), len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    shares = (_CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n).tolist()
    counts = Counter(words)
    sizes = list(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)), float(np.log1p(m)), sum(sizes) / m, float(np.log1p(max(sizes))), len(counts) / m**0.8, *shares,
        sum(map(str.isupper, words)) / m, max(counts.values()) / m, len(zlib.compress(data, 1)) / n,
        1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        1 - sum(map(str.isalpha, words)) / m, sum(map(str.istitle, words)) / m,
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])


# ---------------------------------------------------------------- boosting


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values per bin of a small regression tree over ordered bins, from sums of gradients and hessians."""
    spans = [(0, len(g))]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + RIDGE)
    while len(spans) < leaves:
        best = (1e-9, None)
        for i, (a, b) in enumerate(spans):
            at = np.arange(a + 1, b)
            at = at[(H[at] - H[a] >= LEAF) & (H[b] - H[at] >= LEAF)]
            if len(at):
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (float(gain[j]), (i, int(at[j])))
        if best[1] is None:
            break
        i, at = best[1]
        a, b = spans[i]
        spans[i : i + 1] = [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table in both directions: its gain, and values per cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = np.array(G[:-1, :-1]), np.array(H[:-1, :-1])
    parts = [(a, b), (G[:-1, -1:] - a, H[:-1, -1:] - b), (G[-1:, :-1] - a, H[-1:, :-1] - b), (G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + a, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + b)]
    gain = sum(x * x / (y + RIDGE) for x, y in parts) - G[-1, -1] ** 2 / (H[-1, -1] + RIDGE)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [float(x[i, j] / (y[i, j] + RIDGE)) for x, y in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


class Additive:
    """Lookup tables of features and of pairs of them, over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.wide = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
        rate = float(np.clip((weight @ y + 0.5) / (weight.sum() + 1), 1e-6, 1 - 1e-6))
        self.start = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        fine, wide = self.bins(x)
        f = np.full(len(y), self.start)
        for _ in range(TURNS):
            for k, b in enumerate(fine):
                g, h = self.gradients(f, y, weight)
                size = len(self.tables[k])
                step = RATE * tree(np.bincount(b, g, size), np.bincount(b, h, size))
                self.tables[k] += step
                f += step[b]
        g, h = self.gradients(f, y, weight)
        ranked = sorted(((quadrants(*self.table(wide, i, j, g, h))[0], i, j) for i in range(len(wide)) for j in range(i) if len(self.wide[i]) and len(self.wide[j])), reverse=True)
        self.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.wide[i]) + 1, len(self.wide[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_TURNS):
            for k, (i, j) in enumerate(self.pairs):
                g, h = self.gradients(f, y, weight)
                step = RATE * quadrants(*self.table(wide, i, j, g, h))[1]
                self.pair_tables[k] += step
                f += step[wide[i], wide[j]]

    @staticmethod
    def gradients(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return weight * (y - p), weight * p * (1 - p)

    def table(self, wide: list[np.ndarray], i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(self.wide[i]) + 1, len(self.wide[j]) + 1)
        flat = wide[i] * shape[1] + wide[j]
        return np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        each = lambda cuts: [np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)]
        return each(self.cuts), each(self.wide)

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, wide = self.bins(x)
        f = np.full(len(x), self.start)
        for t, b in zip(self.tables, fine, strict=True):
            f += t[b]
        for t, (i, j) in zip(self.pair_tables, self.pairs, strict=True):
            f += t[wide[i], wide[j]]
        return 1 / (1 + np.exp(-f))


def train(docs: DataFrame, labels: DataFrame, is_training, most: dict[int, int] = MOST) -> Additive | float:
    """A model of the labelled rows that ``is_training`` marks, or their rate where there is one class or none."""
    sample, rows = labelled_sample(docs, labels, "quality", is_training, most)
    got = sample.mapInArrow(_features, "y int, x array<double>").toPandas()
    if got["y"].nunique() < 2:
        return float(got["y"].mean()) if len(got) else 1.0
    y = got["y"].to_numpy(float)
    # An example stands for as many labelled rows of its class as the draw left out, in units of the mean.
    stands = np.where(y == 1, rows[1] / (y == 1).sum(), rows[0] / (y == 0).sum())
    x = np.array(got["x"].tolist())
    order = np.lexsort(x.T)  # the same sums whatever order the rows came in
    return Additive(x[order], y[order], (stands / stands.mean())[order])


def _score(batches: Iterator[pa.RecordBatch], at: int, model) -> Iterator[pa.RecordBatch]:
    """The batches with score after their own columns."""
    model = model.value
    for batch in chunks(batches, at):
        texts = pc.fill_null(batch.column(at), "").to_pylist()
        scores = np.full(len(texts), model) if isinstance(model, float) else model.score(np.array([features(t) for t in texts]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])


def with_quality(docs: DataFrame, labels: DataFrame, is_training=None) -> DataFrame:
    """All columns of ``docs`` by place (c0, c1, ...) and score: one pass over the rows, no join.

    Odd rows and labels are as ``quality_scores`` says; columns may have any names, ``doc_id`` and ``text`` among them.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, fold_of("doc_id", 3) != 1 if is_training is None else is_training))
    return beside(docs, lambda batches, at: _score(batches, at, model), StructField("score", DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame, is_training=None) -> DataFrame:
    """Scores every text of ``docs`` (doc_id, text): doc_id, score, predicted.

    Learns from ``labels`` (doc_id, quality) where ``is_training`` holds; by default ids whose crc32 modulo 3 is not 1.
    Null texts are empty texts, whose features are zeros; long ones are read whole; equal texts score alike. With one
    class of labels only every text gets 0 or 1 as that class says, and without labels 1; of several labels of one id the
    largest counts. Null ids and repeated rows are scored like others; an empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    scored = with_quality(own(docs, "doc_id", "text"), labels, is_training)
    return scored.select(F.col("c0").cast("bigint").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
