"""Spaced seeds against all alignments of all pairs."""

import itertools
import random
import re

from tidewatch.llm import decontamination as dec


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = []
    for k, t in docs:
        doc = words(t)
        for n, item in items:
            own, best = words(item), None
            if not own or (len(own) < dec.SHORTEST and own != doc):
                continue
            window = min(13, len(own))
            for shift in range(-len(own) + window, len(doc) - window + 1):
                low, high = max(0, -shift), min(len(own), len(doc) - shift)
                equal = [own[i] == doc[i + shift] for i in range(low, high)]
                for at in range(len(equal) - window + 1):
                    same = sum(equal[at : at + window])
                    if same >= window - 3 * window // 13 and (window > 5 or same == window):
                        best = max(best or (0,), (same, sum(equal), -(low + shift + at), window))
            if best:
                out.append((k, n, -best[2], best[3], best[0], best[1]))
    return sorted(out, key=str)


def test_masks_hit_every_window():
    """Whatever words are substituted in a window of any length, a mask of its items reads only others."""
    for size in range(6, 14):
        masks = dec.MASKS if size < dec.SHORT else dec.MASKS[:-1]
        for subs in itertools.combinations(range(size), 3 * size // 13):
            assert any(
                not any(mask[p - at] == "1" for p in subs if 0 <= p - at < len(mask)) for mask in masks for at in range(size + 1 - len(mask)))


def test_short_items(spark):
    """Items of 6 to 12 words are found wherever the allowed words are substituted, shorter ones as whole texts."""
    tests, rows = [], []
    for size in range(1, 13):
        item = [f"s{size}x{i}" for i in range(size)]
        tests.append((size, " ".join(item)))
        for subs in itertools.combinations(range(size), 3 * size // 13 if size > 5 else 0):
            text = ["other" if i in subs else w for i, w in enumerate(item)]
            rows.append((size, ("before it " if size > 5 else "") + " ".join(text)))
        rows.append((100 + size, " ".join(["and", *item]) if size < 6 else " ".join("no" if i < 4 else w for i, w in enumerate(item))))
    documents, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    got = sorted(map(tuple, dec.leaks(documents, benchmark).collect()), key=str)
    assert got == brute(rows, tests) and {r[0] for r in got} == set(range(1, 13))


def test_all_alignments(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, rng.choices(vocabulary, k=rng.choice([13, 20, 40]))) for i in range(25)]
    docs = [rng.choices(vocabulary, k=rng.choice([5, 60, 300])) for _ in range(80)]
    for d in docs[:50]:
        _, item = rng.choice(items)
        part = item[: rng.choice([9, 13, len(item)])]
        for _ in range(rng.randint(0, 6)):
            part[rng.randrange(len(part))] = "other"
        at = rng.randrange(len(d) + 1)
        d[at:at] = part
    rows = [(i, ", ".join(d).title()) for i, d in enumerate(docs)]
    rows += [(900, None), (901, ""), (None, " ".join(items[0][1])), (902, " ".join(items[1][1])), (902, " ".join(items[1][1])), (903, "x " * 200_000)]
    tests = [(i, " ".join(t)) for i, t in items] + [(77, None), (78, ""), (79, "w1 w2"), (82, "Only THIS, text"), (80, tuple(items[3])[1] and " ".join(items[3][1])), (81, "one two three four five six")]
    rows += [(904, "and one two three four five six"), (905, "only this text"), (906, "only this text too")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS seed", "3 AS shift")
    benchmark = spark.createDataFrame(tests, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = dec.leaks(documents, benchmark)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, tests)
    kept = dec.without_leaks(documents, benchmark)
    bad = {str(k) for k, *_ in brute(rows, tests)}
    assert kept.columns == documents.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(k) for k, _ in rows if str(k) not in bad)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dec.leaks(docs, items).collect() == [] and dec.leaks(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert len(dec.without_leaks(docs, items).collect()) == 1
