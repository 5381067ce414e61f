"""Toxicity and quality: learners on known shapes, odd rows, and held-out figures on the given tables."""

import os

import numpy as np
import pytest

from tidewatch.llm import compression_quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
CLEAN = "the report of this year was read with care by all the people of the town"


def test_isotonic():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, 200).astype(float)
    y, w = (rng.random(200) < x / 20).astype(float), rng.random(200) + 0.1
    knots, values = toxicity.isotonic(x, y, w)
    assert (np.diff(values) >= 0).all()
    # the least-squares monotone function is the max over lower sets of the min over upper sets of their means
    levels = np.unique(x)
    mean = lambda a, b: (w * y)[(x >= a) & (x <= b)].sum() / w[(x >= a) & (x <= b)].sum()
    want = [max(min(mean(a, b) for b in levels if b >= v) for a in levels if a <= v) for v in levels]
    assert np.allclose(np.interp(levels, knots, values), want)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    trees = toxicity.BoostedTrees().fit(x[:3000], y[:3000], np.ones(3000))
    assert ((trees.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.95


def test_features():
    none = np.empty(0, np.uint64), np.empty(0)
    names = {n: i for i, n in enumerate(toxicity.FEATURES)}
    texts = ["", "You are an IDIOT!!", "this is 1d10t and m*ron talk", "i d i o t", CLEAN, "é" * 50_000 + " you idiot"]
    got = toxicity.features(texts, *none)
    assert not got[0].any()
    assert got[1, names["insult_density"]] == 0.25 and got[1, names["nearness"]] == 0.25
    assert got[1, names["capital_words"]] == 0.25 and got[1, names["repeated_punctuation"]] > 0
    spelled = ["say i d i o t", "a dog", "u i d i o t now", "x" * 60 + "\t1d10t\t" + "y" * 60, "1d10t\u00a0m0r0n\r\nl-o-s-e-r", "i d i", "o t", "a1" * 50_000]
    found = np.expm1(toxicity.features(spelled, *none)[:, names["undisguised"]]).round().astype(int).tolist()
    assert found == [1, 0, 1, 1, 4, 0, 0, 0]  # l-o-s-e-r counts as a token and as letters apart
    assert np.array_equal(np.concatenate([toxicity.features([t], *none) for t in spelled]), toxicity.features(spelled, *none))
    assert got[2, names["undisguised"]] == np.log1p(2) and got[3, names["undisguised"]] == np.log1p(1)
    assert not got[4, [1, 2, 5, 7, 9, 11, 12, 13]].any() and got[5, names["nearness"]] == 0.5
    alone = np.concatenate([toxicity.features([t], *none) for t in texts])
    assert np.array_equal(alone, got)  # a text's features do not depend on its batch


def _samples(n=400):
    rng = np.random.default_rng(5)
    words = np.array(CLEAN.split())
    size = lambda: int(rng.choice([20, 60, 300, 900]))
    good = [" ".join(rng.choice(words, size())) for _ in range(n)]
    bad = [" ".join(w + "###" for w in rng.choice(words, size())) + (" you stupid idiot" if i % 2 else "") for i in range(n)]
    return [(t, 1, 1.0) for t in good] + [(t, 0, 1.0) for t in bad]


@pytest.mark.parametrize("module", [toxicity, compression_quality])
def test_rows(spark, module):
    model = module.fit(_samples())
    draw = lambda n: " ".join(np.random.default_rng(n).choice(CLEAN.split(), n))
    rows = [(1, draw(60)), (2, None), (2, None), (3, ""), (None, "12 !"), (4, draw(50_000)), (5, "the### report### of### you idiot " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS n_words")
    got = module.judge(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > 0.9 and by[4] > 0.9 and by[5] < (0.1 if module is toxicity else 0.5) and len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert module.judge(docs.limit(0), model).collect() == []


@pytest.mark.parametrize(("build", "label"), [(toxicity.toxicity, "toxic"), (compression_quality.quality, "quality")])
def test_few_or_no_labels(spark, build, label):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (2, "c"), (3, None)], "doc_id long, text string")
    for rows, want in (([], None), ([(1, 1)], 1.0), ([(1, None), (None, 1)], None), ([(1, 1), (2, 0), (9, 1)], None)):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int").withColumn("text", F.lit("clash")).withColumn("weight", F.lit(1))
        got = build(docs, labels, F.lit(False)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 and (want is None or r.score == want) for r in got)


def test_quality_by_plain_calls():
    """Sizes from plain compressor calls, and the score as a rising function of their difference alone, the likeliest on the sample's rest."""
    import zstandard

    samples = _samples(120)
    model = compression_quality.fit(samples)
    texts = [t for t, *_ in samples[::7]] + ["", "é", "a" * 5000, "the report ### " * 300]

    def size(raw, dictionary):
        total = 0
        for at in range(0, len(raw), compression_quality.BLOCK):
            made = zstandard.ZstdCompressor(
                level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False,
                write_dict_id=False)
            total += len(made.compress(raw[at : at + compression_quality.BLOCK]))
        return total

    want = [(size(t.encode(), model.bad) - size(t.encode(), model.good)) / max(1, len(t.encode())) for t in texts]
    found = compression_quality.evidence(texts, model.good, model.bad)
    assert np.allclose(found, want)
    order = np.argsort(found)
    assert (np.diff(compression_quality.score(texts, model)[order]) >= 0).all()  # the difference alone decides, and never the wrong way
    intercept, slope = model.line
    assert slope > 0 and np.allclose(compression_quality.score(texts, model), 1 / (1 + np.exp(-(intercept + slope * np.array(want)))))
    rng = np.random.default_rng(0)
    d, w = rng.normal(size=400) / 20, rng.random(400) + 0.5
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 30 * d)))).astype(float)
    loss = lambda a, b: (w * (np.logaddexp(0, a + b * d) - y * (a + b * d))).sum() + (1e-3 * a * a + 0.05 * (b * d.std()) ** 2) / 2
    a, b = compression_quality._logistic(d, y, w)
    assert all(loss(a, b) <= loss(a + i, b + j) + 1e-9 for i in (-0.01, 0, 0.01) for j in (-0.1, 0, 0.1))
    assert compression_quality._logistic(-d, y, w)[1] == 0.0


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="the given tables are not here")
@pytest.mark.parametrize(("name", "label", "least"), [("op6_toxicity", "toxic", 0.7), ("op9_compression_quality", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", label)
    rows = queries.QUERIES[name](spark, LARGE).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r[label] for r in rows]), np.array([r.score for r in rows])
    one, zero = s[y == 1], s[y == 0]
    above = (one[:, None] > zero[None, :]).mean() + (one[:, None] == zero[None, :]).mean() / 2
    assert above > least and (y == [r.predicted for r in rows]).mean() > 0.93


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_clean_documents_stay(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    kept = toxicity.without_toxic(documents, labels)
    assert kept.columns == documents.columns
    clean = documents.join(labels.where("toxic = 0"), "doc_id")
    assert kept.join(labels.where("toxic = 0"), "doc_id").count() > 0.99 * clean.count()
