"""The pipeline's stages on the given tables, each against what is known of its input."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import source_mix

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, FOLDER)
        result.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert set(kept[name]) <= set(before) and docs.count() == len(kept[name])
        assert name == "mix" or (docs.columns == columns and all(kept[name][k] == before[k] for k in kept[name]))
    insult = re.compile(r"\b(idiot|moron|stupid|pathetic|worthless|disgusting|clown|scum|loser|trash)\b", re.I)
    plain = lambda rows: {k for k, r in rows.items() if not insult.search(r.text)}
    assert len(kept["language"]) > 0.98 * len(before)
    assert len(plain(kept["language"]) - set(kept["toxicity"])) < 0.02 * len(before)
    bad = set(kept["language"]) - plain(kept["language"])
    assert len(bad & set(kept["toxicity"])) < 0.1 * len(bad)
    sets = {k: grams(r.text) for k, r in kept["toxicity"].items()}
    holders = {}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, set()).add(k)
    near = {k: {o for g in s for o in holders[g] if o != k and len(s & sets[o]) >= 0.8 * len(s | sets[o])} for k, s in sets.items()}
    stay = set(kept["near_duplicates"])
    assert {k for k in sets if not near[k]} <= stay and not any(near[k] & stay for k in stay)
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {k for k, r in kept["near_duplicates"].items() if any(t in r.text for t in items)}
    assert leaks and not leaks & set(kept["decontamination"])
    assert len(kept["near_duplicates"]) - len(kept["decontamination"]) <= 2 * len(leaks)
    assert docs.columns == [*columns, "copies"] and all(tuple(r)[:-1] == tuple(before[k]) for k, r in kept["mix"].items())
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    total, taken = sum(map(size, kept["decontamination"].values())), sum(size(r) * r.copies for r in kept["mix"].values())
    assert 0.9 * total < taken <= total and all(1 <= r.copies <= 3 for r in kept["mix"].values())
    assert len(kept["mix"]) < len(kept["decontamination"])


def test_the_mix_is_carried_out(spark, tmp_path, monkeypatch):
    """``run`` yields the documents taken, with texts; those cut off are gone, equal ids are kept apart."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("all", lambda spark, docs, sf_dir: docs), corpus_pipeline.STAGES[-1]])
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.limit(400).union(docs.limit(400).withColumn("text", F.reverse("text")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    decided = source_mix.mix(docs).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    assert 0 < len(got) < len(decided) and Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in decided if r.copies)
    assert not Counter((r.doc_id, r.text) for r in got) - texts


CLASHES = (
    "lang_pred score predicted copy rest held_out weight label k _row _node _grams _bands node class class_id n_links n_copies least links component "
    "block group whole i j _number number _item _own _seeds _places seed place bin hit item item_id start words shift rank size target taken "
    "source_size kept finish pass _range one piece upto within before total _text `a.b` Case").split()


def test_clashing_names_come_through(spark, tmp_path):
    """A column of any internal or added name goes through every stage unchanged."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    names = [c.strip("`") for c in CLASHES]
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in names})
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        added = ["copies"] if name == "mix" else []
        assert got.columns == docs.columns + added
        rows = got.collect()
        assert rows and all(tuple(r)[: len(docs.columns)] == tuple(before[r.doc_id]) for r in rows)
        docs = got
    again = source_mix.take(docs)
    assert again.columns == docs.columns and {r.copies for r in again.collect()} <= {1, 2, 3}


def test_odd_rows(spark):
    """Null and empty texts, null ids and repeated rows go through every stage without fault."""
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "", None, None, None), (2, "the words of it and more " * 30, "en", "s", 5), (3, "12 !!", "de", "t", 5)]
    rows += [(2, "the words of it and more " * 30, "en", "s", 5), (4, "der die und das ist nicht " * 20, "de", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        kept = Counter(tuple(r)[:5] for r in stage(spark, docs, FOLDER).collect())
        assert not kept - Counter(rows)


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []
