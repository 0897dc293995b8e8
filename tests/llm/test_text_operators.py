"""The text operators against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymora.llm import hmm, knn, packing, records, sharding, simhash, sketches, units
from kymora.llm.bpe import bpe, bpe_round_trip
from kymora.llm.common import offsets, range_bounds, range_bucket
from kymora.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from kymora.llm.units import encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, bucket int, fp string, part int"
ODD = [
    (5, "The quick brown fox, jumped over 12 lazy dogs! " * 3), (1, None), (2, ""), (3, "one"), (3, "one"), (9, "  \t\n "), (None, "nameless text here"),
    (7, "<|endoftext|> and <|startoftext|>x don't"), (8, "İstanbul ΣΑΣ 日本 é ﬀ"), (4, "word " * 9000), (6, "a\x0bb\x85c\xa0d\x1ce"), (10, "x" * 3000), (11, "a a a a a a a a b"),
]


def documents(spark, rows=ODD):
    return spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], SCHEMA)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_equal_the_library(tokens, name):
    texts = [t or "" for _, t in ODD] + ["'s 'S 're", "a  b\n\nc ", "ª²½µ×÷ßŒŸ", "\x00<|endoftext|", "😀 👍🏽"]
    flat, sizes = encoder(vocabulary(name)).encode(texts)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    for text, ids in zip(texts, parts, strict=True):
        assert ids.tolist() == tokens[name].encode(text, add_special_tokens=False).ids, text


def test_encoders_equal_the_library_on_every_code_point(tokens):
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{c}b {c} x{c}1 Q{c}" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    for name, t in tokens.items():
        want = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        for codec in (encoder(vocabulary(name)), *([bpe(vocabulary(name))] if name.startswith("word") else [])):
            flat, sizes = codec.encode(texts)
            for text, ids, expected in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), want, strict=True):
                assert ids.tolist() == expected, text[:20]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_the_library_on_white_space_and_marks(tokens, name):
    rng = np.random.default_rng(3)
    some = list(" \t\n\r'") * 3 + list("aZé1²½.,-_<|>'st")
    texts = ["".join(rng.choice(some, rng.integers(1, 40))) for _ in range(3000)]
    flat, sizes = encoder(vocabulary(name)).encode(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert ids.tolist() == tokens[name].encode(text, add_special_tokens=False).ids, repr(text)


def test_a_piece_is_encoded_once_however_many_there_are(monkeypatch):
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        codec = units._kind(f.read())
    given, plain = [], units.Library.encode
    monkeypatch.setattr(units.Library, "encode", lambda self, texts: given.append(sum(map(len, texts))) or plain(self, texts))
    parts = ["".join(f" {i}" for i in range(at, at + 150_000)) for at in (0, 150_000)]
    first = [codec.encode([t])[0].tolist() for t in parts]
    assert sum(given) == sum(map(len, parts))
    assert [codec.encode([t])[0].tolist() for t in parts] == first and sum(given) == sum(map(len, parts))


def test_cut_pieces_equal_the_library(tokens, monkeypatch):
    rng = np.random.default_rng(4)
    some = ["'", "'s", "'ll", "'ve", "'re", "'d", "l", "v", "S", "é", "Œ", "×", "²", "1", ".", "<|", "endoftext", "|>", " ", " ", "  ", "\n", "\t", "longerthansixteenbytes", "ünd", "漢"]
    monkeypatch.setattr(units, "CACHE_PIECES", 500)
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        codec = units._kind(f.read())
    fixed = [[], [""], ["", ""], [" a b", "", " c"], ["it's", "'", "s"], ["a ", " b"], ["a", "'s"], ["x" * 70_000, " " * 20]]
    for texts in fixed + [["".join(rng.choice(some, rng.integers(0, 25))) for _ in range(300)] for _ in range(10)]:
        flat, sizes = codec.encode(texts)
        want = [tokens["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_bpe_round_trip(spark, tokens):
    t = tokens["word_bpe_49k.json"]
    got = bpe_round_trip(documents(spark), vocabulary("word_bpe_49k.json")).collect()
    want = collections.Counter()
    for i, text in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[(i, tuple(ids), t.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe_round_trip(documents(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_merge_rounds_take_overlapping_pairs_from_the_left():
    codec = bpe(vocabulary("word_bpe_49k.json"))
    flat, sizes = codec.merger.merge([b"a" * n for n in range(1, 40)])
    assert sizes.sum() == len(flat) and (sizes >= 1).all()


def test_records_round_trip(spark, tokens, tmp_path):
    t = tokens["word_bpe_49k.json"]
    docs = documents(spark)
    folder = f"file://{tmp_path}/rec"
    listed = records.write_records(docs, vocabulary("word_bpe_49k.json"), 2, folder, bucket_rows=4, file_bytes=64)
    got = records.read_records(listed, folder).orderBy("start").collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (i, text) in zip(got, order, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (i, start, len(ids), crc(ids))
        start += len(ids)
    paths = [r["path"] for r in listed.orderBy("bucket", "nth").collect()]
    forward = list(records.read_shuffled(paths[-1]))
    back = list(records.read_shuffled(paths[-1], np.arange(len(forward))[::-1]))
    assert [f[0] for f in forward] == [b[0] for b in back][::-1]
    assert records.round_trip(documents(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_records_notice_damage():
    framed = bytearray(records.frame(b"payload"))
    assert records.unframe(bytes(framed)) == (b"payload", len(framed))
    for at in (0, 9, 14, len(framed) - 1):
        bad = bytearray(framed)
        bad[at] ^= 1
        with pytest.raises(records.BadRecord):
            records.unframe(bytes(bad))
    with pytest.raises(records.BadRecord):
        records.unframe(bytes(framed[:-2]))


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_whole_and_gapless(spark, tokens, capacity):
    t = tokens["byte_bpe_50k.json"]
    got = packing.pack(documents(spark), vocabulary("byte_bpe_50k.json"), capacity=capacity).collect()
    docs = collections.defaultdict(list)
    for i, text in ODD:
        docs[i].append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    assert sum(r["length"] for r in got) == sum(len(x) for v in docs.values() for x in v)
    for r in got:
        assert any(len(x) == r["doc_tokens"] and crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in docs[r["doc_id"]])
    for i, v in docs.items():
        starts = collections.Counter((r["start"], r["length"]) for r in got if r["doc_id"] == i)
        assert sum(n * length for (_, length), n in starts.items()) == sum(map(len, v))
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(documents(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_pads_little(spark):
    got = QUERIES["op2_packing"](spark, SF).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    fills = [r["n"] for r in got]
    padding = sum(2048 - n for n in fills if n & (n - 1))
    assert padding / (sum(fills) + padding) < 0.03


def test_cuts_use_allowed_lengths_only():
    table = packing.lengths(2048, 1 / 64)
    for n in (1, 5, 1024, 1500, 2047, 2048, 2049, 100_000):
        parts = packing.cut(n, table)
        assert sum(parts) == n and all(table[p] == p for p in parts)


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, bits=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(i and i + 10_000, t) for i, t in ODD if i]
    fps = [plain_fingerprint(t) for _, t in rows]
    group = plain_groups(fps)
    low = {}
    for g, (i, _) in zip(group, rows, strict=True):
        low[g] = min(low.get(g, i), i)
    want = collections.Counter((i, f"{f:016x}", low[g]) for (i, _), f, g in zip(rows, fps, group, strict=True))
    got = simhash.simhash_groups(documents(spark, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert simhash.simhash_groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_trees_find_every_near_pair(shards):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in base], np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips, base[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    found = np.zeros_like(near)
    for measures in simhash.blocks_of(4, 3):
        tree = simhash.build(fps, shards, measures, iter(range(1 << 20)))
        rows, leaves, home = simhash.route(tree, fps)
        assert sorted(rows[home].tolist()) == list(range(len(fps)))
        for leaf in np.unique(leaves):
            a, b = rows[(leaves == leaf) & home], rows[leaves == leaf]
            found[np.ix_(a, b)] |= near[np.ix_(a, b)]
    assert (found | found.T)[near].all()


def test_search_joins_what_is_near():
    rng = np.random.default_rng(5)
    hub = rng.integers(0, 2**63, 1, dtype=np.uint64)
    fps = np.unique(np.concatenate([hub ^ (np.uint64(1) << np.arange(60, dtype=np.uint64)), rng.integers(0, 2**63, 900, dtype=np.uint64)]))
    links = simhash.search(fps, fps, simhash.blocks_of(4, 3)[0], 4)
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    assert len(a) < 2000
    assert len(set(a.tolist()) | set(b.tolist())) >= 60


@pytest.mark.parametrize("rows, sample", [(40, 2048), (20, 64)])
def test_shards_split_until_they_fit(spark, rows, sample):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in base], np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips, base[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.contract(simhash.near_links(df, 4, 3, shard_rows=rows, sample=sample)).collect()}
    want = plain_groups([int(f) for f in fps])
    group = {}
    for f, g in zip(fps.view(np.int64).tolist(), want, strict=True):
        group.setdefault(g, set()).add(roots.get(f, f))
    assert all(len(x) == 1 for x in group.values()) and len({min(x) for x in group.values()}) == len(group)


def test_a_hub_is_contracted(spark):
    rng = np.random.default_rng(2)
    hub = [(0, i) for i in range(1, 4000)] + [(i, i + 10_000) for i in range(1, 2000)] + [(-5, 11_999), (20_000, 20_001)]
    some = [tuple(map(int, x)) for x in rng.permutation(np.array(hub))]
    got = {r["node"]: r["root"] for r in simhash.contract(spark.createDataFrame(some, "a long, b long")).collect()}
    assert got.pop(20_001) == 20_000 and set(got.values()) == {-5} and len(got) == 3999 + 1999 + 1


def test_parities_and_marks_bound(spark):
    rng = np.random.default_rng(12)
    sets = [rng.integers(0, 400, int(rng.integers(0, 300))) for _ in range(60)]
    sets = [np.unique(x).astype(np.uint64) for x in sets]
    prints, parities = simhash.set_prints(np.concatenate(sets), np.array([len(x) for x in sets]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            assert int(np.bitwise_count(parities[i] ^ parities[j]).sum()) <= apart and (apart or prints[i] == prints[j])
    values = rng.integers(-(2**63), 2**63 - 1, 3000)
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    hashes = {r["v"]: r["h"] for r in df.select("v", F.xxhash64("v").alias("h")).collect()}
    assert simhash.spark_hash(values.view(np.uint64)).view(np.int64).tolist() == [hashes[int(v)] for v in values]
    marks = simhash.Marks.of(df, "v", len(values))
    assert marks.hold(values).all() and marks.hold(rng.integers(-(2**63), 2**63 - 1, 3000)).mean() < 0.1


def plain_resemblance(a, b):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_copies_match_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, base = [], [f"w{int(k)}" for k in rng.integers(0, 4000, 300)]
    for i in range(60):  # copies with more and more words changed
        words = list(base)
        for k in rng.choice(300, i // 3, replace=False):
            words[k] = f"n{int(rng.integers(0, 10**6))}"
        rows.append((500 + i, " ".join(words)))
    rows += [(i, " ".join(f"w{int(k)}" for k in rng.integers(0, 4000, 80))) for i in range(100)]
    rows += [(700, rows[3][1].upper()), (701, None), (702, ""), (None, "lone"), (703, rows[70][1] + "  "), (703, rows[70][1] + "  ")]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if plain_resemblance(rows[i][1], rows[j][1]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = collections.Counter((d, low.get(find(i))) for i, (d, _) in enumerate(rows))
    got = collections.Counter(tuple(r) for r in simhash.near_copies(documents(spark, rows)).collect())
    assert got - want == want - got
    assert simhash.near_copies(documents(spark, [])).count() == 0


def assert_grouped_as_plain(spark, texts):
    """near_copies of texts numbered from 0 against all pairs; returns how many pairs hold."""
    sets = [plain_set(t) for t in texts]
    low, pairs = list(range(len(texts))), 0

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                low[max(a, b)], pairs = min(a, b), pairs + 1
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark, list(enumerate(texts)))).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    return pairs


def plain_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def changed(rng, words, n):
    words = list(words)
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"n{int(rng.integers(0, 10**9))}"
    return words


def test_near_copies_in_a_crowd_from_one_template(spark):
    rng = np.random.default_rng(21)
    base, fields = [f"w{int(k)}" for k in rng.integers(0, 9000, 400)], np.arange(8, 400, 16)[:24]
    texts = []
    for _ in range(300):
        words = list(base)
        for k in fields:
            words[k] = f"v{int(rng.integers(0, 10**6))}"
        texts += [" ".join(words), " ".join(changed(rng, words, 8))]
    assert assert_grouped_as_plain(spark, texts) > 250


def test_near_copies_that_share_a_small_vocabulary(spark):
    rng = np.random.default_rng(22)
    texts = []
    for words in (60, 60, 60, 400):
        for _ in range(30):
            some = rng.permutation(np.arange(60)) if words == 60 else rng.integers(0, 40, words)
            line = [f"w{int(k)}" for k in some]
            swapped = list(line)
            for k in (range(20, 20 + words // 60) if words == 60 else rng.choice(words - 1, 6, replace=False)):
                swapped[k], swapped[k + 1] = swapped[k + 1], swapped[k]
            texts += [" ".join(line), " ".join(swapped)]
    assert assert_grouped_as_plain(spark, texts) > 100


@pytest.mark.parametrize("kind", ["truncated", "appended", "tail replaced"])
def test_near_copies_changed_in_one_block(spark, kind):
    rng = np.random.default_rng(23)
    texts = []
    for _ in range(120):
        line = [f"w{int(k)}" for k in rng.integers(0, 20_000, int(rng.integers(80, 300)))]
        more = [f"m{int(k)}" for k in rng.integers(0, 20_000, len(line))]
        n = int(len(line) * rng.uniform(0.05, 0.2) / (2 if kind == "tail replaced" else 1))
        copy = {"truncated": line[:-n], "appended": line + more[:n], "tail replaced": line[:-n] + more[:n]}[kind]
        texts += [" ".join(line), " ".join(copy)]
    assert assert_grouped_as_plain(spark, texts) > 80


# ---------------------------------------------------------------- sketches and shards


def plain_shingles(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    numbers = [0] * 4 + [struct.unpack("<q", xxhash.xxh64(w.encode(), 42).digest()[::-1])[0] for w in words]
    out = []
    for i in range(len(words)):
        h = 42
        for v in numbers[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        out.append(h >> 16)
    return out


def test_sketches_match_plain_ones(spark):
    got = sketches.fingerprint_documents(documents(spark)).collect()
    order = sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = collections.Counter()
    bottom = lambda t: sorted(set(plain_shingles(t)))[:128]

    def near(a, b):
        union = sorted(set(a) | set(b))[:128]
        return 1.0 if not union else len(set(union) & set(a) & set(b)) / len(union)

    hexed = lambda s: "".join(f"{h:012x}" for h in s)
    for n, (i, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = bottom(t), bottom(edited), bottom(nxt)
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c))] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert sketches.fingerprint_documents(documents(spark, [])).count() == 0


def test_next_document_across_buckets(spark):
    rows = [(i * 3, f"text number {i} of many words") for i in range(200)]
    df = documents(spark, rows).select("doc_id", "text")
    got = {r["doc_id"]: r["next_text"] for r in sketches.with_next(df, sketches.sketch(F.col("text")), bucket_rows=7).collect()}
    assert got == {i: rows[(n + 1) % 200][1] for n, (i, _) in enumerate(rows)}


def test_sketch_estimates(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[1000:]))], "a string, b string")
    a, b = sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))
    r = df.select(sketches.resemblance(a, b), sketches.distinct(a), sketches.containment(a, b)).first()
    assert abs(r[0] - 1 / 3) < 0.15 and abs(r[1] / 2000 - 1) < 0.3 and abs(r[2] - 0.5) < 0.25
    parts = spark.createDataFrame([(1, " ".join(words[:1500])), (1, " ".join(words[1500:]))], "k int, t string").select("k", sketches.sketch(F.col("t")).alias("sketch"))
    merged = sketches.merged_sketches(parts, "k").first()["sketch"]
    values = sorted({v for p in parts.collect() for v in p["sketch"]})[:128]
    assert merged == values


def plain_jump(key, shards):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 42, *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *[sharding.jump(F.col("k"), n).alias(f"n{n}") for n in (1, 2, 8, 9, 31)])
    for r in df.collect():
        assert tuple(r)[1:] == tuple(plain_jump(r["k"], n) for n in (1, 2, 8, 9, 31))


def test_shards(spark):
    got = sharding.shard_documents(documents(spark)).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["shard"] == plain_jump(r["doc_id"] or 0, 8) and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_native_plans_hold_no_python(spark):
    for name in ("op4_sketches", "op7_sharding"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_range_buckets(spark):
    df = spark.range(1000).union(spark.createDataFrame([(2**62,)], "id long"))
    bounds = range_bounds(df, "id", 8)
    got = df.select("id", range_bucket("id", bounds, F.lit(0.5)).alias("b")).collect()
    assert all(r["b"] == sum(c <= r["id"] for c in bounds) for r in got) and len({r["b"] for r in got}) == 8
    hot = df.union(spark.range(2000).select(F.lit(500).alias("id"))).union(spark.range(900).select(F.lit(None).cast("long").alias("id")))
    bounds = range_bounds(hot, "id", 16)
    cells = [(r["id"] if r["id"] is not None else -(2**63), r["b"]) for r in hot.select("id", range_bucket("id", bounds, F.rand(3)).alias("b")).collect()]
    sizes = collections.Counter(b for _, b in cells)
    assert len({b for i, b in cells if i == 500}) >= 6 and len({b for i, b in cells if i < 0}) >= 3 and max(sizes.values()) < 600
    ends = [(min(i for i, b in cells if b == c), max(i for i, b in cells if b == c)) for c in sorted(sizes)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    cells = spark.createDataFrame([("a", 0, 2), ("a", 1, 3), ("b", 0, 4)], "g string, o int, n int")
    assert {(r["g"], r["o"], r["before"]) for r in offsets(cells, ["g"], "o", "n", "before").collect()} == {("a", 0, 0), ("a", 1, 2), ("b", 0, 0)}


# ---------------------------------------------------------------- neighbours


def plain_neighbours(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in ok:
        if q % 20 == 0:
            best = {}
            for c, w in ok:
                if c != q and len(w) == len(v):
                    s = 0.0
                    for x, y in zip(v, w):
                        s += x * y
                    best[c] = max(best.get(c, -math.inf), s)
            ranked = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:k]
            out += [(q, n, c, s) for n, (c, s) in enumerate(ranked, 1)]
    return out


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # many copies: ties go to the smaller id
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [float("inf")] + [0.0] * 7), (380, [1.0, 2.0]), (381, [3.0, 1.0]), (None, [1.0] * 8), (400, []), (7, rows[9][1]), (420, [1.0, None] + [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, query string")
    got = knn.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_neighbours(rows, 5))
    few = knn.nearest_neighbours(df.where("vec_id in (380, 381)"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert [tuple(r) for r in few] == [(380, 1, 381, 5.0)]
    assert knn.nearest_neighbours(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = [tuple(r) for r in QUERIES[name](spark, SF).select(*want.columns).collect()]
    assert sorted(got) == sorted(want.fetchall())


def test_slots_across_buckets(spark):
    rows = [(i * 5 % 301, f"t{i}") for i in range(301)] + [(7, "t"), (7, "t"), (None, "n")]
    one, many = (sharding.shard_documents(documents(spark, rows), bucket_rows=n).collect() for n in (10_000, 9))
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 16)), rng.normal(size=(60, 16)) * 1e3
    (a, sa, ka, la), (b, sb, kb, lb) = knn.quantise(x), knn.quantise(y)
    got = (a @ b.T) * sa[:, None] * sb[None, :]
    slack = (ka + la)[:, None] * lb[None, :] + la[:, None] * kb[None, :]
    assert (np.abs(x @ y.T - got) <= slack * (1 + 1e-9)).all()


# ---------------------------------------------------------------- language model


def test_hmm_likelihood_is_the_sum_over_all_paths():
    rng = np.random.default_rng(4)
    model = hmm.Model(np.ones(hmm.CLASSES, np.int64), np.ones(hmm.CLASSES, np.int64), 5)
    model.fit(rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)) * 9, rng.random((hmm.CLASSES, hmm.STATES)) * 50)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    seqs = [rng.integers(0, hmm.CLASSES + 1, n) for n in (1, 4, 7)]
    got = hmm.likelihoods(np.concatenate(seqs), np.array([len(s) for s in seqs]), model)
    for s, g in zip(seqs, got):
        a = model.start * model.emit[s[0]]
        for o in s[1:]:
            a = (a[:, None] * model.move).sum(axis=0) * model.emit[o]
        assert math.isclose(g, math.log10(a.sum()), rel_tol=1e-9)


def plain_counts(classes, model):
    """Expected starts, moves and emissions of one document, token by token in double precision."""
    n = len(classes)
    alpha, beta, scale = np.empty((n, hmm.STATES)), np.ones((n, hmm.STATES)), np.empty(n)
    for t in range(n):
        a = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[classes[t]]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = model.move @ (model.emit[classes[t + 1]] * beta[t + 1]) / scale[t + 1]
    move = sum((np.outer(alpha[t], model.emit[classes[t + 1]] * beta[t + 1] / scale[t + 1]) * model.move for t in range(n - 1)), np.zeros((hmm.STATES,) * 2))
    emit = np.zeros((hmm.CLASSES, hmm.STATES))
    np.add.at(emit, classes, alpha * beta)
    return alpha[0] * beta[0], move, emit


def test_baum_welch_counts_whole_documents():
    rng = np.random.default_rng(6)
    model = hmm.Model(np.ones(hmm.CLASSES, np.int64), np.ones(hmm.CLASSES, np.int64), 5)
    model.fit(rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)) + 30 * np.eye(hmm.STATES), rng.random((hmm.CLASSES, hmm.STATES)) ** 8 * 500)
    sizes = np.array([3, 70, 200, 1, 64, 128, 65, 1500, 129])
    classes = rng.integers(0, 50, sizes.sum()).astype(np.uint16)
    want = [sum(x) for x in zip(*(plain_counts(d, model) for d in np.split(classes, np.cumsum(sizes)[:-1])), strict=True)]
    for got, expected in zip(hmm.expect(classes, sizes, model), want, strict=True):
        assert np.allclose(got, expected, rtol=2e-3, atol=2e-3)
    start, move, emit = hmm.expect(classes, sizes, model)
    assert math.isclose(start.sum(), len(sizes), rel_tol=1e-4) and math.isclose(emit.sum(), sizes.sum(), rel_tol=1e-4)
    assert math.isclose(move.sum(), sizes.sum() - len(sizes), rel_tol=1e-4)


def test_language_scores_match_a_plain_model(spark):
    """Classes, start, three plain Baum-Welch passes and a plain forward recursion, document by document."""
    import xxhash

    rng = np.random.default_rng(17)
    sides = [[f"{p}{int(k)}" for k in range(60)] for p in ("alpha", "be")]
    rows = [(i, " ".join(rng.choice(sides[i % 2], int(rng.integers(1, 150))))) for i in range(60)] + [(60, None), (61, "Unseen words here"), (62, " ".join(["alpha1"] * 700))]
    got = {r["doc_id"]: r["score"] for r in hmm.language_scores(documents(spark, rows), F.col("doc_id") % 7 != 2).collect()}
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    kind = lambda w: xxhash.xxh64_intdigest(hmm.class_of(w), 1) % hmm.CLASSES
    train = [i for i, _ in rows if i % 7 != 2]
    counts = collections.Counter(w for i in train for w in words[i])
    known, distinct = np.zeros(hmm.CLASSES, np.int64), np.zeros(hmm.CLASSES, np.int64)
    for w, n in counts.items():
        known[kind(w)] += n
        distinct[kind(w)] += 1
    model = hmm.Model(known, distinct, sum(n == 1 for n in counts.values()))
    classes = {i: np.array([kind(w) for w in words[i]], np.uint16) for i, _ in rows}
    bags = sorted((c.tobytes(), n.astype(np.int32).tobytes()) for c, n in (np.unique(classes[i], return_counts=True) for i in train))
    model.fit(np.ones(hmm.STATES), 50 * np.eye(hmm.STATES), hmm.mixture([(np.frombuffer(c, np.uint16), np.frombuffer(n, np.int32)) for c, n in bags], model))
    for _ in range(hmm.PASSES):
        start, move, emit = (sum(x) for x in zip(*(plain_counts(classes[i], model) for i in train), strict=True))
        model.fit(start, move, emit)
    for i, _ in rows:
        a, total = None, 0.0
        for w in words[i]:
            c = kind(w) if counts[w] else hmm.CLASSES
            a = (model.start if a is None else a @ model.move) * model.emit[c]
            total += math.log10(a.sum()) + (math.log10((counts[w] + 1) / model.within[c]) if counts[w] else 0.0)
            a = a / a.sum()
        assert math.isclose(got[i], total, rel_tol=2e-4), i


def test_language_scores(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, "a b"), (901, None), (902, ""), (903, "unseen"), (903, "unseen")]
    docs = documents(spark, rows)
    got = hmm.language_scores(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(-1)) != 2).collect()
    assert len(got) == len(rows)
    words = lambda t: [w.lower() for w in (t or "").encode().split()]
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for t in train for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for i, t in rows:
        toks = [*words(t), b""]
        want[i].append((len(toks), sum(counts[w] > 0 for w in toks), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks)))
    for r in got:
        assert any(r["n_tokens"] == a and r["n_known"] == b and r["train_tokens"] == c and math.isclose(r["base_score"], d, rel_tol=1e-9) for a, b, c, d in want[r["doc_id"]])
    held = [r for r in got if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert hmm.language_scores(documents(spark, []), F.lit(True)).count() == 0
    lone = hmm.language_scores(documents(spark, [(1, "x y")]), F.lit(False)).collect()
    assert [tuple(r)[2:] for r in lone] == [(3, 0, 0, 0.0, 0.0)]
