"""The operators applied to their whole tables, and the SQL that checks those which SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import attention_lm, compression_quality, decontamination, fill_in_middle, html_extraction, importance_resampling, language_crf, maxscore, ngram_join, quality_rules, source_mix, token_counts, toxicity
from tidewatch.llm.common import fold

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document; a text over 2,048 tokens is marked."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer, limit=2048)


@query("op1_language_crf")
def op1_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Main language of every document; documents whose fold is 1 of 3 are not learned from."""
    return language_crf.main_language(spark, table(spark, folder, "documents"), fold("doc_id", 3) == 1)


@query("op8_source_mix", source_mix.MIX_SQL)
def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed: sources weigh 5, 2, 1 in turn, none goes over three times its size."""
    mixed = source_mix.mix(table(spark, folder, "documents"), weights=(5, 2, 1), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


TOP_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS terms FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, list_inner_product(q.terms, v.terms)::BIGINT AS score
  FROM v AS q JOIN v ON q.row <> v.row WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op2_maxscore", TOP_SQL)
def op2_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector, against all vectors."""
    return maxscore.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class of near duplicates and number of links: five words, similarity 0.8 or more."""
    return ngram_join.near_duplicates(table(spark, folder, "documents"), n=5, threshold=0.8, recall=0.9999)


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with up to 3 of 13 words substituted."""
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract(table(spark, folder, "pages"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels whose fold is 0 of 5 are not learned from."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.toxicity(documents, labels, fold("doc_id", 5) == 0)


@query("op9_compression_quality")
def op9_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; labels whose fold is 2 of 4 are not learned from."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return compression_quality.quality(documents, labels, fold("doc_id", 4) == 2)


@query("op10_attention_lm")
def op10_attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of every document; documents whose fold is 2 of 7 are not learned from."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return attention_lm.score(table(spark, folder, "documents"), fold("doc_id", 7) == 2, tokenizer)


@query("op12_fill_in_middle", fill_in_middle.FILL_SQL)
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut in three and put together for filling in; digests of the output and of the text rebuilt from it."""
    cut = fill_in_middle.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op13_importance_resampling", importance_resampling.RESAMPLE_SQL)
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn by likeness to the benchmark's words; all documents with their scores."""
    chosen = importance_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return chosen.select("doc_id", "n_features", "weight", "score", "rank")


@query("op11_quality_rules")
def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, and whether the base rule and the learned rules keep it."""
    judged = quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
