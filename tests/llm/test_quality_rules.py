"""Counts against plain loops, trees against a plain walk and their directions, odd rows, and held-out figures."""

import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import quality_rules as rules
from tidewatch.llm import queries
from tidewatch.llm.common import fold

FOLDER, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WORDS = "the report of this year was read with care by all the people of a town near our river".split()


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside), failed


def drawn_texts(n=120):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        words = list(rng.choice(WORDS, int(rng.integers(0, 80))))
        if i % 3 == 0 and len(words) > 12:
            words += words[2:9] + ["#"] + words[3:8]
        out.append("".join(w + rng.choice([" ", "\n", "\t", "\n\n", "\x0b", " | ", "\r\n"], p=[0.7, 0.1, 0.04, 0.04, 0.02, 0.05, 0.05]) for w in words))
    return out


ODD = ["", " \n\t", "a b c d e a b c d e", "x " * 40, "same line\nsame line\n same line\n\n\n", "one word here", "é#* <>" * 7, "a b c d e f\na b c d e f\nz"]


def test_counts_against_plain_loops():
    texts = ODD + drawn_texts() + ["long text " * 50_000 + "end", *ODD]
    counts, shares = rules.statistics(texts)
    failed = rules.base_failed(counts)
    assert [(*map(int, c), bool(f)) for c, f in zip(counts, failed)] == [plain(t) for t in texts]
    for i, t in enumerate(texts):  # a text's figures do not depend on its batch
        alone = rules.statistics([t])
        assert np.array_equal(alone[0][0], counts[i]) and np.allclose(alone[1][0], shares[i])
    assert np.isfinite(shares).all()


def walk(trees, row):
    total = trees.base
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        total += trees.value[at]
    return total


def test_trees_learn_and_keep_their_directions():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    free = rules.grow(x[:3000], y[:3000], np.ones(3000), [0, 0, 0])
    assert ((free.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    assert np.allclose(free.margin(x[:300]), [walk(free, r) for r in x[:300]])
    held = rules.grow(x[:3000], y[:3000], np.ones(3000), [-1, 0, 1], depth=4)
    noisy = rules.grow(x[:500], rng.integers(0, 2, 500).astype(float), np.ones(500), [-1, 0, 1], depth=5, least_weight=0.1)
    for trees in (held, noisy):
        for feature, sign in ((0, -1), (2, 1)):
            rows = np.repeat(rng.random((60, 3)), 200, axis=0)
            rows[:, feature] = np.tile(np.linspace(-0.1, 1.1, 200), 60)
            steps = np.diff(trees.margin(rows).reshape(60, 200), axis=1) * sign
            assert (steps >= -1e-9).all()
        assert np.ptp(noisy.margin(x)) > 0.1


def _labelled(spark, n=300):
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice(WORDS, int(rng.integers(30, 300)))) + "." for _ in range(n)]
    bad = [" ".join(w + "###" for w in rng.choice(WORDS, int(rng.integers(30, 300)))) for _ in range(n)]
    rows = [(i, t, int(i < n)) for i, t in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return frame.drop("quality"), frame.select("doc_id", "quality")


def test_rows(spark):
    docs, labels = _labelled(spark)
    trees = rules.train(docs, labels)
    rng = np.random.default_rng(6)
    clean = " ".join(rng.choice(WORDS, 200)) + "."
    rows = [(1, clean), (2, None), (2, None), (3, ""), (None, clean), (4, " ".join(rng.choice(WORDS, 60_000)) + "."), (5, clean.replace(" ", "### ")), (6, "to be or " * 100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS n_words", "8 AS kept", "7 AS x")
    got = rules.judge(frame, trees).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].kept and by[None].kept and by[1].x == 7 and by[1].n_words == 200
    assert not by[5].kept and not by[5].base_failed and by[6].base_failed and not by[6].kept
    assert by[2].base_failed and not by[2].kept and [r.score for r in got if r.doc_id in (2, 3)].count(by[3].score) == 3
    assert by[4].n_words == 60_000 and rules.judge(frame.limit(0), trees).collect() == []


def test_few_or_repeated_labels(spark):
    docs = spark.createDataFrame([(1, "a b " * 10), (2, "c " * 12), (2, "c"), (3, None), (None, "x")], "doc_id long, text string")
    for rows, kept in (([], True), ([(1, 1), (1, 1)], True), ([(2, 0)], False), ([(1, None), (None, 1)], True), ([(1, 1), (1, 0), (2, 1), (9, 0)], None)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int").withColumn("text", F.lit("clash")).withColumn("weight", F.lit(1))
        trees = rules.train(docs, labels)
        if kept is not None:
            assert (trees.margin(np.zeros((2, len(rules.STATISTICS)))) > 0).all() == kept
        assert len(rules.judge(docs, trees).collect()) == 5


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="the given tables are not here")
def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    trees = rules.train(docs, labels.where(fold("doc_id", 4) != 2))
    rows = rules.judge(docs, trees).join(labels, "doc_id").where(fold("doc_id", 4) == 2).select("quality", "base_failed", "score", "kept").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) > 0.99 * len(good) and sum(r.kept for r in bad) < 0.1 * len(bad)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.QUERIES["op11_quality_rules"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(docs[r.doc_id])
