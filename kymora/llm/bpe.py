"""Word-end byte-level BPE in batched numpy merge rounds, and decoding.

The symbols of many words lie in one flat array. Each round looks up the pairs that are new by binary search over the
sorted pair keys, finds each word's lowest rank, and joins all its pairs of that rank, left to right; words without a
known pair leave. A distinct word is merged once per worker. Texts that are not plain Latin are normalised and parted
into words by the library's own rules; the merges are numpy's for all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kymora.llm.common import chunks, own, ship
from kymora.llm.units import CACHE_WORDS, END, PIECES, SAFE, STATED, Index, Ragged, byte_letters

NO_RANK = np.iinfo(np.int64).max


class Merger:
    """Merge rules as sorted keys, ``left id << 32 | right id``, with ranks and results."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.joined = keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = sorted((b, c) for c, b in byte_letters().items())
        self.inner = np.array([vocab[c] for _, c in letters], np.int64)
        self.last = np.array([vocab[c + END] for _, c in letters], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and each word's number of ids; no word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        tail = np.cumsum(sizes) - 1
        symbols[tail] = self.last[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        out_flat, out_word = [], []
        word = np.repeat(np.arange(len(words)), sizes)
        # Rank of the pair that starts at each symbol; none at a word's last.
        ranks = np.full(len(symbols), NO_RANK)
        inside = np.flatnonzero(word[:-1] == word[1:]) if len(word) > 1 else np.empty(0, np.int64)
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(ranks, starts)
            live = np.repeat(low < NO_RANK, np.diff(starts, append=len(symbols)))
            if not live.all():
                out_flat.append(symbols[~live])
                out_word.append(word[~live])
                symbols, word, ranks = symbols[live], word[live], ranks[live]
                low = low[low < NO_RANK]
                if not len(symbols):
                    break
                starts = np.flatnonzero(np.diff(word, prepend=-1))
            hit = ranks == np.repeat(low, np.diff(starts, append=len(symbols)))
            # In a run of overlapping hits every second one waits.
            at = np.flatnonzero(hit)
            fresh = np.diff(at, prepend=-2) != 1
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            symbols[at] = self.joined[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            now = moved[at]
            new = np.unique(np.concatenate([now, now[now > 0] - 1]))
            ranks[new] = NO_RANK
            new = new[new + 1 < len(symbols)]
            new = new[word[new] == word[new + 1]]
            ranks[new] = self.rank(symbols[new], symbols[new + 1])
        flat, owner = np.concatenate([*out_flat, np.empty(0, np.int64)]), np.concatenate([*out_word, np.empty(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return flat[order].astype(np.uint32), np.bincount(owner, minlength=len(words))


class BPE:
    """Encoder and decoder of a vocabulary file with word ends; truncation and padding of the file stay unused."""

    def __init__(self, raw: str):
        rules = json.loads(raw)
        model = rules["model"]
        steps = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        patterns = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != END or steps != ["NFC", "Replace", "Lowercase"] or odd or STATED not in patterns:
            raise ValueError("not a byte-level BPE vocabulary with word ends")
        from tokenizers import Tokenizer

        # Which code points are letters, and their lower case, differs between versions of Unicode: only the library's own counts.
        library = Tokenizer.from_str(raw)
        self.normal, self.pre, self.bytes = library.normalizer, library.pre_tokenizer, byte_letters()
        self.merger = Merger(model)
        self.added = {t["content"]: t["id"] for t in rules.get("added_tokens") or []}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        tokens = {i: t for t, i in (model["vocab"] | self.added).items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self._clear()

    def _clear(self) -> None:
        self.index, self.known = Index(), Ragged()

    def words(self, text: str) -> list:
        """A text's normalised words, and (id,) for an added token in it."""
        if SAFE.fullmatch(text) and "<|" not in text:
            return PIECES.findall(text.lower())
        out: list = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append((self.added[part],))
            elif part:
                pieces = self.pre.pre_tokenize_str(self.normal.normalize_str(part))
                out += [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in pieces]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and each text's number of ids."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        words: list = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            got = self.words(t)
            counts[i] = len(got)
            words += got
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            new = self.index.new
            plain = [w.encode() for w in new if isinstance(w, str)]
            flat, sizes = self.merger.merge(plain) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
            if len(plain) < len(new):
                it = iter(np.split(flat, np.cumsum(sizes)[:-1]) if plain else [])
                parts = [next(it) if isinstance(w, str) else np.array(w, np.uint32) for w in new]
                flat, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
            self.known.extend(flat, sizes)
            new.clear()
        flat, sizes = self.known.take(rows)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        last = np.cumsum(counts)
        return flat, ends[last] - ends[last - counts]

    def decode(self, ids: list[int]) -> str:
        """The tokens, special ones included, joined by spaces: the file names no decoder that would undo more."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[str, BPE] = {}


def bpe(path: str) -> BPE:
    """This worker's BPE for a vocabulary file."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            _loaded[path] = BPE(f.read())
    return _loaded[path]


def _round_trip(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    codec = bpe(vocabulary)
    for batch in chunks(batches):
        flat, sizes = codec.encode(pc.fill_null(batch.column(1), "").to_pylist())
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat.tolist()
        decoded = [codec.decode(ids[a:b]) for a, b in zip(ends, ends[1:])]
        arrays = [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))), pa.array(decoded)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])


def bpe_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and decodes the ids again: doc_id, ids, decoded.

    Null and empty texts have no ids and decode to the empty text; long ones are encoded whole. Added tokens within a text
    are single ids. Null ids and repeated rows are documents like others; an empty table gives no rows; further columns
    are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    return own(docs, "doc_id", "text").mapInArrow(lambda b: _round_trip(b, vocabulary), "doc_id long, ids array<int>, decoded string")
