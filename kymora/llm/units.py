"""Whole-text token ids, just as the tokenizers library gives them, at several times its speed.

Both encoders hand every text that is not plain Latin to the library itself. The others, whose character classes, white
space and lower case no library disputes, are cut into the pieces that the vocabulary's pattern states; a piece's ids
don't hang on its neighbours, so the library encodes each distinct piece once and texts are looked up. Byte-level pieces
are cut and looked up by numpy and Arrow, many texts at a time.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

#: Plain Latin: ASCII without odd controls, Latin-1 without NBSP, NEL and soft hyphen, and the three further letters of French.
SAFE = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff\u0152\u0153\u0178]*")
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff\u0152\u0153\u0178"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The word pattern that word-end vocabularies state, with its classes spelled out for plain Latin.
STATED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^ \t\n\r{LETTERS}{NUMBERS}]+")
END = "</w>"
#: Words kept by a worker before its cache starts anew; bounds its memory.
CACHE_WORDS = 250_000
#: Byte-level pieces kept likewise; they lie in arrays, at some 60 bytes each.
CACHE_PIECES = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Index(dict):
    """Numbers its keys as they come and lists those not numbered before."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        at = self[unit] = len(self)
        self.new.append(unit)
        return at


class Ragged:
    """Rows of ids in one flat, growing array."""

    def __init__(self, dtype=np.uint32):
        self.flat, self.start, self.size, self.rows, self.used = np.empty(1 << 16, dtype), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0, 0

    def _room(self, name: str, need: int) -> None:
        array = getattr(self, name)
        if need > len(array):
            grown = np.empty(max(need, 2 * len(array)), array.dtype)
            grown[: len(array)] = array
            setattr(self, name, grown)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(sizes), len(flat)
        for name in ("start", "size"):
            self._room(name, self.rows + n)
        self._room("flat", self.used + m)
        self.flat[self.used : self.used + m] = flat
        self.size[self.rows : self.rows + n] = sizes
        self.start[self.rows : self.rows + n] = self.used + np.cumsum(sizes) - sizes
        self.rows, self.used = self.rows + n, self.used + m

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids one after another, and each row's number of them."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[rows] - ends + sizes, sizes)
        return self.flat[at], sizes


class Library:
    """The library's own encoder; the base of the faster ones and what they fall back on."""

    def __init__(self, raw: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(raw)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and each text's number of ids."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def mixed(self, texts: list[str], whole: list[int], flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``flat`` with the ids of the texts numbered in ``whole``, which it lacks, put in by the library."""
        if not whole:
            return flat, sizes
        extra, n = Library.encode(self, [texts[i] for i in whole])
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        for i, ids in zip(whole, np.split(extra, np.cumsum(n)[:-1]), strict=True):
            parts[i] = ids
        sizes[whole] = n
        return np.concatenate(parts), sizes


class PieceEncoder(Library):
    """Looks up the ids of a text's pieces, which the library gives once for each distinct piece."""

    def __init__(self, raw: str, rules: dict):
        super().__init__(raw)
        self.added = [t["content"] for t in rules.get("added_tokens") or []]
        self.index, self.known = Index(), Ragged()

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces."""
        return Library.encode(self, pieces)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self.index, self.known = Index(), Ragged()
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        whole: list[int] = []
        for i, t in enumerate(texts):
            if not SAFE.fullmatch(t) or ("<|" in t and any(a in t for a in self.added)):
                whole.append(i)
            else:
                got = self.cut(t)
                counts[i] = len(got)
                pieces += got
        rows = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if self.index.new:
            self.known.extend(*self.learn(self.index.new))
            self.index.new.clear()
        flat, sizes = self.known.take(rows)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        last = np.cumsum(counts)
        return self.mixed(texts, whole, flat, ends[last] - ends[last - counts])


class WordEncoder(PieceEncoder):
    """Word-end BPE: white space and case fold away, so the pieces are lower-case words."""

    def __init__(self, raw: str, rules: dict):
        super().__init__(raw, rules)
        self.ends = np.zeros(max(rules["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for w, i in rules["model"]["vocab"].items() if w.endswith(END)]] = True

    def cut(self, text: str) -> list[str]:
        return PIECES.findall(text.lower())

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A few hundred at a time as one text, cut again after each id that ends a word."""
        flat, _ = Library.encode(self, [" ".join(pieces[i : i + 256]) for i in range(0, len(pieces), 256)])
        last = np.flatnonzero(self.ends[flat])
        if len(last) != len(pieces):
            return Library.encode(self, pieces)
        return flat, np.diff(last, prepend=-1)


LETTER, NUMBER, MARK, WHITE = 1, 2, 3, 4


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each ASCII byte, and of each two-byte character by its bytes as one number; for plain Latin only."""
    one, two = np.full(256, MARK, np.uint8), np.full(1 << 16, MARK, np.uint8)
    for pattern, kind in ((LETTERS, LETTER), (NUMBERS, NUMBER), ("\t\n\r\x20", WHITE)):
        for c in map(chr, range(0x180)):
            if re.fullmatch(f"[{pattern}]", c):
                raw = c.encode()
                (one if len(raw) == 1 else two)[int.from_bytes(raw)] = kind
    return one, two


ONE_BYTE, TWO_BYTES = _classes()


def byte_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level BPE begin in plain Latin texts, which lie in ``data`` from offset to offset.

    Its pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ space L N]+|space+(?!not space)|space+``: runs of a class, of which
    each takes the blank before it, but for a lone apostrophe, which takes the ending after it.
    """
    if not len(data):
        return np.empty(0, np.int64)
    kind = ONE_BYTE[data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = TWO_BYTES[data[lead].astype(np.int64) << 8 | data[lead + 1]]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(new)  # runs
    kinds, size, led = kind[at], np.diff(at, append=len(data)), ~first[at]
    # White space before something else of its text parts with its last character; a blank goes to what follows.
    after = np.flatnonzero((kinds[:-1] == WHITE) & led[1:]) + 1
    new[at[after] - 1] = True
    after = after[data[at[after] - 1] == 0x20]
    new[at[after]] = False
    alone = (kinds == MARK) & (size == 1) & (data[at] == 0x27)
    alone[after] = False
    ending = np.flatnonzero(alone[:-1] & (kinds[1:] == LETTER) & led[1:]) + 1
    begin, room = at[ending], size[ending]
    a, b = data[begin], np.where(room > 1, data[np.minimum(begin + 1, len(data) - 1)], 0)
    taken = np.isin(a, list(b"sdmt")) + 2 * (((a == 0x6C) & (b == 0x6C)) | (((a == 0x76) | (a == 0x72)) & (b == 0x65)))
    new[begin[taken > 0]] = False
    new[(begin + taken)[(taken > 0) & (taken < room)]] = True
    return np.flatnonzero(new)


class Shelf:
    """Numbers byte strings as they come: those of up to 16 bytes, none of them 0, by open addressing, longer ones in a dict."""

    WIDTH = 16
    _MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")

    def __init__(self):
        self.slots = np.full(1 << 12, -1, np.int32)
        self.low, self.high, self.longer, self.rows = np.zeros(1 << 12, "<u8"), np.zeros(1 << 12, "<u8"), {}, 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + (low >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out, todo, at = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high)
        while len(todo):
            got = self.slots[at]
            same = (got >= 0) & (self.low[got] == low[todo]) & (self.high[got] == high[todo])
            out[todo[same]] = got[same]
            on = (got >= 0) & ~same
            todo, at = todo[on], at[on] + 1 & len(self.slots) - 1
        return out

    def _put(self, rows: np.ndarray) -> None:
        todo, at = rows, self._slot(self.low[rows], self.high[rows])
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            on = self.slots[at] != todo
            todo, at = todo[on], at[on] + 1 & len(self.slots) - 1

    def number(self, units: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct strings, and places of those not numbered before, in the order of their numbers."""
        offsets = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
        data = np.concatenate([np.frombuffer(units.buffers()[2], np.uint8)[: offsets[-1]], np.zeros(2 * self.WIDTH, np.uint8)])
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        start, size = offsets[:-1], np.diff(offsets)
        low, high = eight[start] & self._MASK[np.minimum(size, 8)], eight[start + 8] & self._MASK[np.clip(size - 8, 0, 8)]
        short = np.flatnonzero(size <= self.WIDTH)
        out = np.full(len(units), -1, np.int64)
        out[short] = self._find(low[short], high[short])
        long = np.flatnonzero(size > self.WIDTH)
        names = units.take(pa.array(long)).to_pylist()
        out[long] = [self.longer.get(x, -1) for x in names]
        new = np.flatnonzero(out < 0)
        out[new] = rows = np.arange(self.rows, self.rows + len(new))
        self.rows += len(new)
        self.longer.update((x, n) for x, n in zip(names, out[long].tolist(), strict=True))
        if self.rows > len(self.low):
            more = np.zeros(max(self.rows, 2 * len(self.low)) - len(self.low), "<u8")
            self.low, self.high = np.concatenate([self.low, more]), np.concatenate([self.high, more])
        self.low[rows], self.high[rows] = low[new], high[new]
        kept = rows[size[new] <= self.WIDTH]
        if 2 * self.rows > len(self.slots):
            self.slots = np.full(2 << (2 * self.rows).bit_length(), -1, np.int32)
            kept = np.setdiff1d(np.arange(self.rows), np.fromiter(self.longer.values(), np.int64, len(self.longer)), assume_unique=True)
        self._put(kept)
        return out, new


class ByteEncoder(Library):
    """Byte-level BPE: a piece is a word with the blank before it, a run of digits or marks, or white space."""

    def __init__(self, raw: str, rules: dict):
        super().__init__(raw)
        self.added = [t["content"] for t in rules.get("added_tokens") or []]
        self.shelf, self.known = Shelf(), Ragged()
        vocabulary = self.library.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))  # a letter for each byte

    def learn(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces. Those that begin with a blank are cut alike after one another, so many are one text to the library."""
        names, size = pieces.cast(pa.large_string()).to_pylist(), np.diff(np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1])
        blank = np.fromiter((len(x) > 1 and x[0] == " " and x[1] not in "\t\n\r " for x in names), bool, len(names))
        led, rest = np.flatnonzero(blank), np.flatnonzero(~blank)
        of = [names[i] for i in led.tolist()]
        texts = ["".join(of[i : i + 128]) for i in range(0, len(of), 128)]
        if not texts or any(a in t for t in texts for a in self.added):
            return Library.encode(self, names)
        flat, _ = Library.encode(self, texts)
        told, ends = np.cumsum(self.width[flat]), np.cumsum(size[led])
        last = np.searchsorted(told, ends)
        if last[-1] + 1 != len(flat) or (told[last] != ends).any():  # a vocabulary without letters for some bytes
            return Library.encode(self, names)
        both = Ragged()
        both.extend(flat, np.diff(last, prepend=-1))
        both.extend(*Library.encode(self, [names[i] for i in rest.tolist()]))
        return both.take(np.argsort(np.concatenate([led, rest])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.shelf.rows > CACHE_PIECES:
            self.shelf, self.known = Shelf(), Ragged()
        whole = [i for i, t in enumerate(texts) if not SAFE.fullmatch(t) or any(a in t for a in self.added)]
        if whole:
            plain = list(texts)
            for i in whole:
                plain[i] = ""
        else:
            plain = texts
        raw = [t.encode() for t in plain]
        joined = b"".join(raw)
        data, offsets = np.frombuffer(joined, np.uint8), np.cumsum([0, *map(len, raw)])
        begin = byte_pieces(data, offsets)
        bounds = np.append(begin, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
        flat, sizes = np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(begin):
            rows, new = self.shelf.number(pieces.dictionary)
            if len(new):
                self.known.extend(*self.learn(pieces.dictionary.take(pa.array(new))))
            flat, sizes = self.known.take(rows[pieces.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.mixed(texts, whole, flat, np.diff(ends[np.searchsorted(begin, offsets)]))


def _kind(raw: str) -> Library:
    rules = json.loads(raw)
    model, pre, normal = rules.get("model") or {}, rules.get("pre_tokenizer") or {}, rules.get("normalizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal and not model.get("end_of_word_suffix"):
        return ByteEncoder(raw, rules)
    steps = [n.get("type") for n in normal.get("normalizers", [])]
    if plain and model.get("end_of_word_suffix") == END and steps == ["NFC", "Replace", "Lowercase"] and STATED in json.dumps(pre).replace("\\\\", "\\"):
        return WordEncoder(raw, rules)
    return Library(raw)


_encoders: dict[str, Library] = {}


def encoder(path: str) -> Library:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            _encoders[path] = _kind(f.read())
    return _encoders[path]
