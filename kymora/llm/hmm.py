"""A hidden Markov language model over word classes, trained by Baum-Welch across partitions.

A word's class follows from its letters: short words by themselves, longer ones by their ending, hashed to CLASSES.
States emit classes, and a class emits its words by their add-one counts, so the model has a bounded number of
parameters while the word counts stay a distributed table. The unknown word is one symbol, a class of its own, whose
probability in every state is the share of training tokens seen once (Good and Turing's estimate of unseen mass); the
probabilities of all words and that symbol sum to one. Texts are encoded once into blocks with a dictionary each;
Baum-Welch passes sum expected counts over whole training documents, and the scaled forward recursion scores whole texts.
Documents are worked on in segments, side by side: products of a segment's steps carry forward and backward messages
from segment to segment, so nothing is lost where a document is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import meet, own, save, ship
from kymora.llm.units import Index

CLASSES, STATES = 1 << 15, 8
#: Words up to this many bytes are classes by themselves; longer ones go by as many last bytes less one.
SHORT = 5
#: Passes over all training tokens; iterations and documents of the start, a mixture fitted to a bounded sample.
PASSES, START_TURNS, START_DOCS = 3, 20, 2000
#: Tokens of a segment, segments worked on at once, and steps after which products are scaled.
SEGMENT, SEGMENTS, RESCALE = 64, 1024, 4
#: A word that is one of so many training tokens is common: there are at most as many such words.
COMMON = 65_536
#: Pseudo-tokens of the unigram model in each state, and of each transition.
PRIOR, MOVES = 500.0, 1.0
BLOCK_DOCS, BLOCK_TOKENS = 4096, 1 << 21
#: Bits of a block's number within its task, and of a place in its dictionary: a place anywhere is one bigint.
TASK_BITS, PLACE_BITS = 16, 26
END = b""
BLOCKS = "block long, doc_ids array<long>, train binary, sizes binary, tokens binary, keys binary, classes binary, counts binary"


def class_of(word: bytes) -> bytes:
    return word if len(word) <= SHORT else b"\0" + word[1 - SHORT :]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as numbers in a dictionary of their distinct words, each with its hash, class and training count."""
    import xxhash
    from pyspark import TaskContext

    digest, n_block = xxhash.xxh64_intdigest, TaskContext.get().partitionId() << TASK_BITS

    def close() -> pa.RecordBatch:
        nonlocal n_block
        flat = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
        named = index.new
        lengths = np.array(sizes, np.int32)
        trained = np.repeat(np.array(train, bool), lengths)
        row = [
            [n_block], [ids], [np.array(train, np.uint8).tobytes()], [lengths.tobytes()], [flat.tobytes()],
            [np.fromiter(map(digest, named), np.uint64, len(named)).tobytes()],
            [np.fromiter((digest(class_of(w), 1) % CLASSES for w in named), np.uint16, len(named)).tobytes()],
            [np.bincount(flat[trained], minlength=len(named)).astype(np.int64).tobytes()],
        ]
        n_block += 1
        kinds = [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    index, words, ids, train, sizes = Index(), [], [], [], []
    for batch in batches:
        for doc, text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got = (text or "").encode().lower().split()
            if ids and (len(ids) >= BLOCK_DOCS or len(words) + len(got) + 1 > BLOCK_TOKENS):
                yield close()
                index, words, ids, train, sizes = Index(), [], [], [], []
            words += got
            words.append(END)
            ids.append(doc), train.append(t), sizes.append(len(got) + 1)
    if ids:
        yield close()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per dictionary entry: (place anywhere, key, class, count)."""
    for batch in batches:
        for block, keys, classes, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            keys, classes, n = np.frombuffer(keys, np.int64), np.frombuffer(classes, np.uint16).astype(np.int32), np.frombuffer(n, np.int64)
            place = (block << PLACE_BITS) + np.arange(len(keys))
            for at in range(0, len(keys), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (place, keys, classes, n)], names=["place", "key", "class", "n"])


# ---------------------------------------------------------------- the model


class Model:
    """``emit`` (CLASSES + 1, STATES): class probabilities, the last row the unknown word's; ``within``: words' mass of each class."""

    def __init__(self, known: np.ndarray, distinct: np.ndarray, once: int):
        self.tokens, self.words = int(known.sum()), int(distinct.sum())
        self.within = (known + distinct).astype(float)
        self.unknown = float(np.clip(once / max(1, self.tokens), 1 / (self.tokens + self.words + 1), 0.5)) if self.tokens else 1.0
        self.share = self.within / max(1.0, self.within.sum())
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.05 / max(1, STATES - 1))
        np.fill_diagonal(self.move, 0.95)
        self.move /= self.move.sum(axis=1, keepdims=True)
        self.emit = self.with_unknown(np.repeat(self.share[:, None], STATES, axis=1))

    def with_unknown(self, emit: np.ndarray) -> np.ndarray:
        return np.vstack([emit * (1 - self.unknown), np.full(STATES, self.unknown)])

    def fit(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """The maximum-a-posteriori parameters of expected counts."""
        self.start = (start + MOVES) / (start + MOVES).sum()
        self.move = (move + MOVES) / (move + MOVES).sum(axis=1, keepdims=True)
        emit = emit + PRIOR * self.share[:, None]
        self.emit = self.with_unknown(emit / emit.sum(axis=0))


def mixture(docs: list[tuple[np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    """Expected class counts of each state from a mixture of unigram models over whole documents: where Baum-Welch starts.

    A document is its distinct classes and their counts. Each state is first seeded by the document that those before it
    say least of, per token.
    """
    used, col = np.unique(np.concatenate([c for c, _ in docs]), return_inverse=True)
    row = np.repeat(np.arange(len(docs)), [len(c) for c, _ in docs])
    n = np.concatenate([k for _, k in docs]).astype(float)
    size = np.bincount(row, n)
    share = model.share[used]
    logs = np.zeros((len(docs), STATES))
    far = np.full(len(docs), -np.inf)
    enough = size >= min(50, size.max())
    for s in range(STATES):
        seed = int(np.argmin(np.where(enough, far if s else -size, np.inf)))
        mine = row == seed
        counts = np.bincount(col[mine], n[mine], len(used)) + 50 * share
        logs[:, s] = np.bincount(row, n * np.log(counts / counts.sum())[col], len(docs))
        far = np.maximum(far, logs[:, s] / size)
    for _ in range(START_TURNS):
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        emit = np.stack([np.bincount(col, n * p[row, s], len(used)) for s in range(STATES)], axis=1)
        smooth = emit + 50 * share[:, None]
        log_emit = np.log(smooth / smooth.sum(axis=0))
        logs = np.stack([np.bincount(row, n * log_emit[col, s], len(docs)) for s in range(STATES)], axis=1) + np.log(p.mean(axis=0) + 1e-9)
    out = np.zeros((CLASSES, STATES))
    out[used] = emit
    return out


class Segments:
    """Pieces of at most SEGMENT tokens of documents, longest first: ``at`` (place), ``size``, ``nth`` in its document, ``doc``."""

    def __init__(self, sizes: np.ndarray):
        pieces = -(-sizes // SEGMENT)
        first = np.cumsum(pieces) - pieces
        doc = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(pieces.sum()) - first[doc]
        size = np.minimum(SEGMENT, sizes[doc] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        self.at, self.size, self.nth, self.doc = ((np.cumsum(sizes) - sizes)[doc] + nth * SEGMENT)[order], size[order], nth[order], doc[order]
        # Where the nth piece of a document stands in this order: row_of[first[doc] + nth].
        self.first, self.pieces, self.row_of = first, pieces, np.empty(len(order), np.int64)
        self.row_of[order] = np.arange(len(order))

    def products(self, rows: np.ndarray, classes: np.ndarray, E: np.ndarray, A: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each piece, longest first, what its steps do to a forward message, up to a factor; a document's first
        piece starts from ``start`` whatever the message."""
        at, size = self.at[rows], self.size[rows]
        out = np.where((self.nth[rows] == 0)[:, None, None], start[None, None, :], A[None, :, :]).astype(np.float32)
        out *= E[classes[at]][:, None, :]
        for t in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -t, side="left"))
            live = (out[:n].reshape(-1, STATES) @ A).reshape(n, STATES, STATES) * E[classes[at[:n] + t]][:, None, :]
            out[:n] = live / live.max(axis=(1, 2), keepdims=True) if t % RESCALE == 0 else live
        return out / out.max(axis=(1, 2), keepdims=True)

    def messages(self, classes: np.ndarray, E: np.ndarray, A: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's forward message from the piece before and backward message from the piece after."""
        ahead, back = np.ones((len(self.at), STATES), np.float32), np.ones((len(self.at), STATES), np.float32)
        long = np.flatnonzero(self.pieces > 1)
        if not len(long):
            return ahead, back
        rows = np.flatnonzero(self.pieces[self.doc] > 1)
        which = np.empty(len(self.at), np.int64)
        which[rows] = np.arange(len(rows))
        steps = np.concatenate([self.products(rows[i : i + SEGMENTS], classes, E, A, start) for i in range(0, len(rows), SEGMENTS)])
        long = long[np.argsort(-self.pieces[long], kind="stable")]
        counts = self.pieces[long]
        for k in range(1, int(counts[0])):
            docs = long[: int(np.searchsorted(-counts, -k, side="left"))]
            before, now = self.row_of[self.first[docs] + k - 1], self.row_of[self.first[docs] + k]
            a = np.einsum("di,dij->dj", ahead[before], steps[which[before]])
            ahead[now] = a / a.sum(axis=1, keepdims=True)
            last = self.first[docs] + self.pieces[docs]
            now, before = self.row_of[last - k], self.row_of[last - k - 1]
            b = np.einsum("dij,dj->di", steps[which[now]], back[now])
            back[before] = b / b.max(axis=1, keepdims=True)
        return ahead, back


def expect(classes: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of whole documents' tokens, by scaled forward and backward recursion."""
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
    E, A, S = model.emit.astype(np.float32), model.move.astype(np.float32), model.start.astype(np.float32)
    cut = Segments(sizes)
    ahead, behind = cut.messages(classes, E, A, S)
    for at in range(0, len(cut.at), SEGMENTS):
        p, n, f = cut.at[at : at + SEGMENTS], cut.size[at : at + SEGMENTS], cut.nth[at : at + SEGMENTS] == 0
        T = int(n[0])
        real = np.arange(T)[:, None] < n[None, :]
        obs = classes[np.where(real, p[None, :] + np.arange(T)[:, None], 0)].astype(np.int64)
        em = E[obs]
        em[~real] = 1.0
        # alpha[0] is the message from before, alpha[t + 1] that of token t.
        alpha, scale = np.empty((T + 1, len(p), STATES), np.float32), np.empty((T, len(p), 1), np.float32)
        alpha[0] = ahead[at : at + SEGMENTS]
        for t in range(T):
            a = (np.where(f[:, None], S, alpha[0] @ A) if t == 0 else alpha[t] @ A) * em[t]
            scale[t] = a.sum(axis=1, keepdims=True)
            live = real[t][:, None]
            # Past a piece's end its last message stays.
            alpha[t + 1] = np.where(live, a / scale[t], alpha[t])
        b = behind[at : at + SEGMENTS]
        b = b / (alpha[T] * b).sum(axis=1, keepdims=True)
        back = np.empty_like(em)
        for t in range(T - 1, -1, -1):
            live = real[t][:, None]
            back[t] = b
            em[t] *= np.where(live, b / scale[t], 0)
            b = np.where(live, em[t] @ A.T, b)
        # back[t] is beta; em[t] is now emission * beta / scale, the right side of a move into t.
        gamma = alpha[1:] * back
        gamma[~real] = 0
        start += gamma[0][f].sum(axis=0, dtype=float)
        em[0][f] = 0  # a document's first token is moved into from nowhere
        move += model.move * (alpha[:-1].reshape(-1, STATES).T @ em.reshape(-1, STATES)).astype(float)
        seen = obs[real]
        for s in range(STATES):
            emit[s] += np.bincount(seen, gamma[:, :, s][real], CLASSES)
    return start, move, emit.T


def _training(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(classes, sizes, ids) of each block's training documents."""
    get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
    for ids, train, sizes, tokens, classes in zip(*map(get, ("doc_ids", "train", "sizes", "tokens", "classes")), strict=True):
        train, sizes = np.frombuffer(train, np.uint8).astype(bool), np.frombuffer(sizes, np.int32).astype(np.int64)
        flat = np.frombuffer(classes, np.uint16)[np.frombuffer(tokens, np.int32)]
        if train.any():
            yield flat[np.repeat(train, sizes)], sizes[train], [i for i, t in zip(ids, train.tolist()) if t]


def _expect(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """This task's expected counts: a row per class seen, rows -1 - i for moves from state i, and -1 - STATES for starts."""
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    for batch in batches:
        for classes, sizes, _ in _training(batch):
            for total, part in zip((start, move, emit), expect(classes, sizes, model.value), strict=True):
                total += part
    seen = np.flatnonzero(emit.any(axis=1))
    keys = np.concatenate([seen, -1 - np.arange(STATES + 1)])
    values = np.vstack([emit[seen], move, start])
    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(v) for v in values.T.copy())], names=["key", *(f"s{i}" for i in range(STATES))])


def _start_docs(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Distinct classes, and their counts, of the training documents that a hash of their ids draws: bounded however long they are."""
    import xxhash

    for batch in batches:
        for classes, sizes, ids in _training(batch):
            ends = np.cumsum(sizes)
            drawn = [i for i, d in enumerate(ids) if xxhash.xxh32_intdigest(str(d), 11) < share * (1 << 32)]
            bags = [np.unique(classes[ends[i] - sizes[i] : ends[i]], return_counts=True) for i in drawn]
            if bags:
                arrays = [pa.array([c.tobytes() for c, _ in bags], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in bags], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["classes", "counts"])


def train(blocks: DataFrame, model: Model, n_docs: int) -> Model:
    """Baum-Welch passes over all training tokens of the blocks, from a start that a bounded sample gives."""
    spark = blocks.sparkSession
    data = blocks.select("doc_ids", "train", "sizes", "tokens", "classes")
    drawn = data.mapInArrow(lambda b: _start_docs(b, min(1.0, START_DOCS / max(1, n_docs))), "classes binary, counts binary").collect()
    if not drawn:
        return model
    ordered = sorted((bytes(r["classes"]), bytes(r["counts"])) for r in drawn)  # the same start whatever order the rows came in
    emit = mixture([(np.frombuffer(c, np.uint16), np.frombuffer(n, np.int32)) for c, n in ordered], model)
    model.fit(np.ones(STATES), 50 * np.eye(STATES), emit)
    names = [f"s{i}" for i in range(STATES)]
    for _ in range(PASSES):
        sent = spark.sparkContext.broadcast(model)
        parts = data.mapInArrow(lambda b, sent=sent: _expect(b, sent), "key long, " + ", ".join(f"{n} double" for n in names))
        # CLASSES + STATES + 1 rows at most.
        got = parts.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        keys, values = got["key"].to_numpy(), got[names].to_numpy()
        emit = np.zeros((CLASSES, STATES))
        emit[keys[keys >= 0]] = values[keys >= 0]
        move = np.zeros((STATES + 1, STATES))
        move[-1 - keys[keys < 0]] = values[keys < 0]
        model.fit(move[STATES], move[:STATES], emit)
    return model


# ---------------------------------------------------------------- scores


def likelihoods(classes: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Exact log10 likelihood of each whole document's classes: the forward recursion over all documents in step."""
    order = np.argsort(-sizes, kind="stable")
    at = (np.cumsum(sizes) - sizes)[order]
    alive = np.searchsorted(-sizes[order], -np.arange(sizes.max() if len(sizes) else 0), side="left")
    out = np.zeros(len(sizes))
    a = None
    for t, n in enumerate(alive.tolist()):
        a = (np.repeat(model.start[None, :], n, axis=0) if t == 0 else a[:n] @ model.move) * model.emit[classes[at[:n] + t]]
        scale = a.sum(axis=1)
        out[:n] += np.log10(scale)
        a /= scale[:, None]
    back = np.empty(len(sizes))
    back[order] = out
    return back


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(block: pd.DataFrame, entries: pd.DataFrame, model: Model) -> pd.DataFrame:
    names = [x.split()[0] for x in SCORES.split(", ")]
    if block.empty:
        return pd.DataFrame({n: [] for n in names})
    row = block.iloc[0]
    sizes, tokens = np.frombuffer(row["sizes"], np.int32).astype(np.int64), np.frombuffer(row["tokens"], np.int32)
    classes = np.frombuffer(row["classes"], np.uint16).astype(np.int64)
    c = np.zeros(len(classes))
    c[entries["place"].to_numpy() & ((1 << PLACE_BITS) - 1)] = entries["c"].to_numpy()
    known = c > 0
    base = np.log10((c + 1) / (model.tokens + model.words + 1))
    within = np.where(known, np.log10((c + 1) / np.maximum(model.within[classes], 1)), 0.0)
    starts = np.cumsum(sizes) - sizes
    per = lambda x: np.add.reduceat(x[tokens], starts)
    score = likelihoods(np.where(known, classes, CLASSES)[tokens], sizes, model) + per(within)
    train = np.frombuffer(row["train"], np.uint8).astype(bool)
    ids = pd.array(list(row["doc_ids"]), dtype="Int64")
    return pd.DataFrame(dict(zip(names, (ids, train, sizes, per(known.astype(np.int64)), model.tokens, per(base), score), strict=True)))


def language_scores(docs: DataFrame, is_training: Column) -> DataFrame:
    """Trains on the texts of ``docs`` (doc_id, text) that ``is_training`` marks, by those two columns, and scores all.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score, both log10 of the
    text's probability. Tokens are words, A-Z folded, and an end; null and empty texts are the end alone; long texts are
    trained on and scored whole. Without training texts every token is the unknown word. Equal texts score alike; null
    ids and repeated rows are documents like others; an empty table gives no rows; further columns are ignored, whatever
    their names. Words are counted by a 64-bit hash.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = own(docs, "doc_id", "text").select("doc_id", "text", F.coalesce(is_training, F.lit(False)).alias("train"))
    blocks, _ = save(docs.mapInArrow(_encode, BLOCKS), "blocks")
    entries = blocks.select("block", "keys", "classes", "counts").mapInArrow(_entries, "place long, key long, class int, n long")
    counts, _ = save(entries.where("n > 0").groupBy("key").agg(F.sum("n").alias("c"), F.min("class").alias("class")), "words")
    known, distinct, once = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64), 0
    for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect():
        known[r["class"]], distinct[r["class"]] = r["c"], r["v"]
        once += r["once"]
    n_docs = blocks.select(F.sum(F.size("doc_ids"))).first()[0] or 0
    model = train(blocks, Model(known, distinct, once), n_docs)
    sent = spark.sparkContext.broadcast(model)
    # A common word is an entry of nearly every block; there are COMMON such words at most.
    found = meet(entries.select("place", "key"), counts, "key", ["c"], counts.where(F.col("c") > model.tokens // COMMON))
    found = found.where("c is not null").select("place", "c", F.shiftright("place", PLACE_BITS).alias("block"))
    payload = blocks.select("block", "doc_ids", "train", "sizes", "tokens", "classes")
    return payload.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(lambda a, b: _score(a, b, sent.value), SCORES)
