"""The chain's probabilities against sums over all labellings; predictions on small and odd inputs."""

import itertools
import os

import numpy as np
import pytest

from tidewatch.llm import language_crf as crf
from tidewatch.llm import queries

FOLDER = "/root/testdata/sf0.01"
ENGLISH = "the and of that with this from have which there were being people because through"
GERMAN = "der die und nicht mit sich auch werden zwischen schlichkeit einheit ungefähr über schön"


def brute(emit, begins, transitions, start):
    n, k = emit.shape
    total, mass = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        score = sum(emit[i, y] + (start[y] if begins[i] else transitions[path[i - 1], y]) for i, y in enumerate(path))
        total += np.exp(score)
        for i, y in enumerate(path):
            mass[i, y] += np.exp(score)
    return mass / total


@pytest.mark.parametrize("chunk", [2, 3, 96])
def test_forward_backward(monkeypatch, chunk):
    monkeypatch.setattr(crf, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    for n in (1, 4, 7):
        emit, transitions, start = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        begins = rng.random(n) < 0.3
        begins[0] = True
        assert np.allclose(crf._posterior(emit, begins, transitions, start), brute(emit, begins, transitions, start))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    draw = lambda words: " ".join(rng.choice(words.split(), 40))
    return crf.fit([(draw(w), lang) for _ in range(12) for w, lang in ((ENGLISH, "en"), (GERMAN, "de"))])


def test_switched_text(spark, model):
    text = "Die schlichkeit und der 12 people which were from"
    spans = crf.language_spans(spark.createDataFrame([(1, text), (2, None), (3, "12!")], "doc_id long, text string"), model)
    assert [(text[r.start : r.end], r.lang) for r in spans.orderBy("start").collect()] == [
        ("Die schlichkeit und der", "de"), ("people which were from", "en")]


def test_odd_rows(spark, model):
    long = "the people and " * 50_000
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (3, "123 !", "b"), (None, "mit der einheit", None), (4, long, "c"), (5, "the of", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = sorted(((r.doc_id, r.extra, r.lang_pred) for r in crf.identify(docs, model).collect()), key=str)
    want = [(1, "a", "und"), (1, "a", "und"), (2, "a", "und"), (3, "b", "und"), (4, "c", "en"), (5, "d", "en"), (None, None, "de")]
    assert got == sorted(want, key=str)
    assert crf.identify(docs.limit(0), model).collect() == []


def test_no_label_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert crf.identify(docs, crf.train(docs)).first().lang_pred == "und"
    assert crf.accepted(docs).columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_held_out_accuracy(spark):
    got = queries.QUERIES["op1_language_crf"](spark, FOLDER)
    assert got.columns[:3] == ["doc_id", "held_out", "lang_pred"] or set(got.columns) >= {"doc_id", "held_out", "lang_pred", "score"}
    rows = got.join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
