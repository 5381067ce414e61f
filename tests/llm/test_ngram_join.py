"""The join against all pairs of n-gram sets."""

import random

import pytest

from tidewatch.llm import ngram_join
from tidewatch.llm.components import components


def grams(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def brute(rows):
    sets = [grams(t) for _, t in rows]
    linked = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    near = [[j for j in range(len(rows)) if i != j and linked(sets[i], sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min([root[i], *(root[j] for j in others)])
            changed |= low != root[i]
            root[i] = low
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root[i]] = min(least.get(root[i], k), k)
    return sorted(((k, least.get(root[i]), len(near[i]), 1 if not sets[i] else sets.count(sets[i])) for i, (k, _) in enumerate(rows)), key=str)


def sample(seed, near=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda k: rng.choices(vocabulary, k=k)
    texts, base = [draw(rng.choice([3, 8, 60, 200])) for _ in range(60)], draw(120)
    for _ in range(near):  # a large group of copies that differ
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(copy)
    for t in texts[:25]:
        copy = list(t)
        if len(copy) > 20:
            copy[rng.randrange(len(copy))] = "changed"
        texts += [copy, list(t)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(9000, None), (9001, ""), (9002, " \n "), (9003, "One two"), (9004, "one  TWO"), (None, rows[0][1]), (9005, rows[0][1]), (9005, rows[0][1])]


@pytest.mark.parametrize("block", [16, 512])
def test_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    rows = sample(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_links", "2 AS node")
    got = ngram_join.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_one_of_each(spark):
    rows = sample(5, near=10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'x' AS component")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    groups = {r[1] for r in brute([(i, t) for i, (_, t) in enumerate(rows)])}
    assert len(texts) == len(groups)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            assert not grams(a) or len(grams(a) & grams(b)) < 0.8 * len(grams(a) | grams(b))


def test_empty_and_long(spark):
    docs = spark.createDataFrame([(1, "one two three four five six " * 40_000)], "doc_id long, text string")
    assert [tuple(r) for r in ngram_join.near_duplicates(docs).collect()] == [(1, 1, 0, 1)]
    assert ngram_join.near_duplicates(docs.limit(0)).collect() == []


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.9999, 4)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges += [(7, 7), (-5, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)
