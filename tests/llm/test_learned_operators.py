"""The learned operators: held-out accuracy, exact search, odd rows; the pipeline against its parts."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kymora.llm import quality, toxicity
from kymora.llm.common import labelled_sample
from kymora.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, y int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 9) for i, t in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def held_out(spark, name, label):
    got = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    return [(r["score"], r["predicted"], r[label]) for r in got]


def test_quality_on_held_out_rows(spark):
    got = held_out(spark, "op5_quality", "quality")
    assert len(got) > 80 and np.mean([p == y for _, p, y in got]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    got = held_out(spark, "op9_toxicity", "toxic")
    hits = sum(p and y for _, p, y in got)
    assert hits >= 0.4 * sum(y for *_, y in got) and sum(p and not y for _, p, y in got) <= 0.06 * len(got)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    rows = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(60, rng.integers(1, 9), replace=False)} for _ in range(700)]
    index = toxicity.Index(list(range(700)), [i % 2 for i in range(700)], rows, {0: 1.0, 1: 1.0}, 60)
    dense = np.zeros((700, 60))
    at = {int(i): n for n, i in enumerate(index.ids)}
    for i, c in enumerate(rows):
        terms, w = index.unit(c)
        dense[at[i], terms] = w
    for _ in range(40):
        query = {int(t): 1 for t in rng.choice(60, 5, replace=False)}
        terms, w = index.unit(query)
        cos = dense[:, terms] @ w
        found, c = index.nearest(query, 10)
        assert np.allclose(np.sort(cos)[::-1][:10], c) and np.allclose(cos[found], c)


def test_calibration_rises():
    low, rate = toxicity.calibrate(np.array([0.1, 0.2, 0.2, 0.6, 0.9]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    assert (np.diff(low) > 0).all() and (np.diff(rate) > 0).all()


ODD = [(1, None), (2, ""), (2, ""), (None, "words"), (3, "idiot " * 20_000), (4, "fine words here"), (5, "\n\n"), (6, "日本 语")]


def test_odd_rows_and_labels(spark):
    some = labels(spark, [(2, 1, 0, "a"), (3, 0, 1, "b"), (3, None, 0, "b"), (4, 1, 0, "c"), (None, 1, 1, "d"), (77, 0, 1, "e"), (6, 7, 7, "f")])
    for score in (toxicity.toxicity_scores, quality.quality_scores):
        for known in (some, some.where("doc_id = 2"), some.where("false")):
            got = score(docs(spark, ODD), known, F.lit(True)).collect()
            assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD)
            assert all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in got)
        assert score(docs(spark, []), some).count() == 0


def test_sample_is_bounded_and_single(spark):
    many = docs(spark, [(i, f"t{i}") for i in range(3000)] + [(5, "again")] * 20)
    known = labels(spark, [(i, i % 2, i % 3 == 0 and 1 or 0, "x") for i in range(3000)])
    sample, rows = labelled_sample(many, known, "quality", F.lit(True), {0: 100, 1: 10_000})
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    assert rows == {0: 1500, 1: 1500} and n[1] == 1500 and 50 < n[0] < 160
    assert sample.count() == sample.select("doc_id").distinct().count()


def test_features_of_empty_and_odd_texts():
    assert len({len(quality.features(t)) for t in ("", " ", "a", "A!! B!!", "\n", "\ud800x".encode("utf-8", "replace").decode())}) == 1


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Additive(x, y, np.ones(4000))
    assert np.mean((model.score(x) >= 0.5) == y) > 0.9


def test_pipeline_is_its_stages(spark):
    docs_in = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs_in
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs_in.columns, name
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = docs_in.where(F.col("doc_id").isin(list(ids)))
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1 or quality = 0").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 0 and quality = 1").collect()}
    assert len(ids & bad) <= 0.5 * len(bad) and clean


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(4)
    text = [" ".join(f"w{int(k)}" for k in rng.integers(0, 5000, 60)) for _ in range(7)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[1].upper()), (3, text[2]), (3, text[2]), (9, text[2] + " more")]
    rows += [(4, text[3]), (4, text[4]), (5, text[4]), (None, text[5]), (6, text[5]), (7, text[6]), (None, None), (None, "")]
    got = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), SMALL)
    kept = Counter((r["doc_id"], (r["text"] or "").lower()) for r in got.collect())
    assert got.columns == docs(spark, []).columns
    assert kept == Counter([(None, text[0]), (None, text[1]), (3, text[2]), (4, text[3]), (4, text[4]), (6, text[5]), (7, text[6]), (None, "")])
    assert corpus_pipeline.drop_near_copies(spark, docs(spark, []), SMALL).count() == 0


ROWS = [(1, "plain words of a first text"), (2, "plain words of a second one"), (None, None), (3, ""), (3, ""), (4, "long " * 30_000)]


def clashing(spark, rows, text="text", doc="doc_id"):
    """Documents beside columns whose names clash with them, with each other, and with what operators call their own."""
    names = ["TEXT", doc, "Doc_ID", text, "score", "__score", "row", "key", "bucket", "c0", "evidence", "train", "h", "fp"]
    kind = ", ".join(f"x{i} {'long' if n == doc else 'string'}" for i, n in enumerate(names))
    return spark.createDataFrame([["odd", i, "9", t, *["z"] * (len(names) - 4)] for i, t in rows], kind).toDF(*names)


def test_stages_take_clashing_columns_and_odd_rows(spark):
    df = clashing(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, SMALL)
        assert name == "packing" or got.columns == df.columns
        rows = got.collect()
        assert rows or name == "quality classifier", name
        assert stage(spark, df.where("false"), SMALL).count() == 0
    assert len(corpus_pipeline.drop_near_copies(spark, df, SMALL).collect()) == 4


def test_operators_take_clashing_columns(spark):
    from kymora.llm import bpe, hmm, packing, records, sharding, simhash, sketches
    from kymora.llm.queries import vocabulary

    df, plain = clashing(spark, ROWS), docs(spark, ROWS)
    known = labels(spark, [(1, 1, 0, "a"), (2, 0, 1, "b")]).toDF("DOC_ID", "QUALITY", "TOXIC", "y")
    train = F.col("doc_id").isNotNull()
    word, byte = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
    for run in (
        lambda d: packing.pack(d, byte), simhash.simhash_groups, simhash.near_copies, sketches.fingerprint_documents,
        lambda d: quality.quality_scores(d, known, train), lambda d: hmm.language_scores(d, train), sharding.shard_documents,
        lambda d: records.round_trip(d, word), lambda d: toxicity.toxicity_scores(d, known, train), lambda d: bpe.bpe_round_trip(d, word),
    ):
        assert Counter(map(str, run(df).collect())) == Counter(map(str, run(plain).collect()))


def test_quality_scores_are_sums_of_tables(spark):
    """The score, feature by feature and pair by pair, from the fitted tables."""
    import bisect

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()][:120] + [(900, None), (901, "")]
    known = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs(spark, rows), known, F.lit(True))
    got = Counter((r["doc_id"], round(r["score"], 9)) for r in quality.quality_scores(docs(spark, rows), known, F.lit(True)).collect())
    want = Counter()
    for i, t in rows:
        x = quality.features(t or "")
        f = model.start + sum(float(table[bisect.bisect_right(cuts.tolist(), v)]) for table, cuts, v in zip(model.tables, model.cuts, x, strict=True))
        for table, (a, b) in zip(model.pair_tables, model.pairs, strict=True):
            f += float(table[bisect.bisect_right(model.wide[a].tolist(), x[a]), bisect.bisect_right(model.wide[b].tolist(), x[b])])
        want[(i, round(1 / (1 + math.exp(-f)), 9))] += 1
    assert got == want and len({s for _, s in got}) > 20


def test_a_tree_takes_the_best_cuts():
    rng = np.random.default_rng(8)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.uniform(1, 6, 9)
        loss = lambda a, b, g=g, h=h: g[a:b].sum() ** 2 / (h[a:b].sum() + quality.RIDGE)
        cuts = [i for i in range(1, 9) if h[:i].sum() >= quality.LEAF and h[i:].sum() >= quality.LEAF]
        best = max(cuts, key=lambda i: loss(0, i) + loss(i, 9))
        got = quality.tree(g, h, leaves=2)
        if loss(0, best) + loss(best, 9) - loss(0, 9) > 1e-9:
            assert np.allclose(got[:best], g[:best].sum() / (h[:best].sum() + quality.RIDGE)) and np.allclose(got[best:], g[best:].sum() / (h[best:].sum() + quality.RIDGE))


def test_toxicity_scores_are_votes_of_the_nearest(spark):
    """Cosines with every example, the sixteen best, their weighed votes, and the calibrating step."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:300] + [(9000, None), (9001, "")]
    every, known = docs(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(every, known, F.lit(True))
    index, read = model.index, toxicity.Reader({t: i for i, t in enumerate(model.terms)})
    assert index is not None
    examples = [{} for _ in index.ids]
    for at, key in enumerate(index.keys):
        for n in range(index.ends[at], index.ends[at + 1]):
            examples[index.row[n]][int(key % index.n_terms)] = float(index.value[n])
    scored = toxicity.with_toxicity(every, known, F.lit(True))
    got = {r["c0"]: r["score"] for r in scored.collect()}
    held = 0
    for i, t in rows[:300]:
        counts = read.counts(t or "")
        weights = {k: (1 + math.log(n)) * float(index.idf[k]) for k, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        near = sorted(((-sum(w / length * e.get(k, 0.0) for k, w in weights.items()), n) for n, e in enumerate(examples)), key=lambda x: (round(x[0], 12), x[1])) if counts else []
        near = [(-c, n) for c, n in near[: toxicity.NEIGHBOURS] if c < 0]
        if not counts:
            assert got[i] == model.base
            continue
        held += 1
        part = [(c * c * float(index.weights[n]), int(index.labels[n])) for c, n in near]
        mean = float(index.weights.mean())
        vote = (sum(w * y for w, y in part) + toxicity.PRIOR * mean * model.prior) / (sum(w for w, _ in part) + toxicity.PRIOR * mean)
        low, rate = model.steps
        near_step = [float(r) for v, r in zip(low, rate, strict=True) if v <= vote + 1e-9][-1:] or [float(rate[0])]
        other = [float(r) for v, r in zip(low, rate, strict=True) if v <= vote - 1e-9][-1:] or [float(rate[0])]
        assert any(math.isclose(got[i], s, rel_tol=1e-9) for s in (*near_step, *other)), i
    assert held > 10
