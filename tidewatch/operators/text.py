"""Text mining: forms of logged texts, XML explosion, long aggregation, matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.nulls import null_if_blank
from tidewatch.operators.ordered import CHUNK, comparable, match_by, split_hot_groups
from tidewatch.session import staged

# Fixed values: (pattern, replacement), applied in this order. Each reduces one kind of
# detail: query blocks, objects, objects in a query block, strings, numbers, pairs of
# numbers, and lists of objects, of pairs and of numbers.
FORM_RULES = (
    (r'([@>])"((SE[LT]|INS|UPD|DEL|MRG)\$[0-9A-F_]+|APEX\$INNER|G?V_[A-Z_]*)"', "$1{qblk}"),
    (r'"[A-Za-z_][A-Za-z0-9_$#]*"(\."[A-Za-z_][A-Za-z0-9_$#]*")*', "{obj}"),
    (r"\{obj\}@\{qblk\}", "{obj}"),
    (r"'[^']*'", "{string}"),
    (r"\d+", "{number}"),
    (r"\(\{number\}\s+\{number\}\)", "{number_pair}"),
    (r"\{obj\}(\s+\{obj\})+", "{list_of_objects}"),
    (r"\{number_pair\}(\s+\{number_pair\})+", "{list_of_number_pairs}"),
    (r"\{number\}(\s+\{number\})+", "{list_of_numbers}"),
)
# A text matches the rule of the same position only if it contains this; null means any text.
FORM_MARKS = ('"', '"', "{obj}@{qblk}", "'", None, "({number}", "{obj}", "{number_pair}", "{number}")
LEADING_KEYWORD = r"^[A-Z][A-Z_]*"


def with_form(
    df: DataFrame, text: str, form: str, rules: Sequence[tuple[str, str]] = FORM_RULES,
    marks: Sequence[str | None] = FORM_MARKS,
) -> DataFrame:
    """Add the text with its details replaced, rule after rule.

    A regular expression runs only on texts that contain its mark, which is far cheaper to
    look for.
    """
    out = df.withColumn(form, F.col(text))
    for (pattern, replacement), mark in zip(rules, marks):
        replaced = F.regexp_replace(form, pattern, replacement)
        if mark is not None:
            replaced = F.when(F.col(form).contains(mark), replaced).otherwise(F.col(form))
        out = out.withColumn(form, replaced)
    return out


def text_forms(
    df: DataFrame, text: str, identifier: str, rules: Sequence[tuple[str, str]] = FORM_RULES,
    marks: Sequence[str | None] = FORM_MARKS, exact: bool = False,
) -> DataFrame:
    """Per form: its leading keyword, a sample text and id, and the number of distinct ids.

    Every distinct text is reduced to its form once, with a sketch of its ids; the sketches of a
    form's texts are merged. The count is therefore approximate (1.6 % standard error at the
    sketch's size); ``exact`` adds the true count, for which the forms of the distinct texts are staged
    and meet the distinct pairs of text and id. Ids are whole numbers or texts; null ids are not
    counted. Samples are the least values, so that results repeat.
    """
    rows = df.select(F.col(text).alias("_text"), F.col(identifier).alias("_id"))
    texts = rows.groupBy("_text").agg(F.min("_id").alias("_first"), F.hll_sketch_agg("_id").alias("_sketch"))
    formed = with_form(texts, "_text", "form", rules, marks)
    if exact:
        formed = staged(formed, "forms")
    keyword = null_if_blank(F.regexp_extract("form", LEADING_KEYWORD, 0))
    out = formed.groupBy("form").agg(
        F.min("_text").alias("text_sample"), F.min("_first").alias("id_sample"),
        F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias("ids_estimate"))
    if exact:
        pairs = rows.where("_id IS NOT NULL").distinct()
        counts = match_by(pairs, formed.select("_text", "form"), ["_text"]).groupBy("form").agg(F.count_distinct("_id").alias("ids"))
        out = match_by(out, counts, ["form"]).withColumn("ids", F.coalesce("ids", F.lit(0)))
    return out.withColumn("keyword", keyword)


def malformed(xml: Column) -> Column:
    """Whether a text is no XML element that ends."""
    return F.from_xml(xml, "_corrupt_record string")["_corrupt_record"].isNotNull()


def xml_explode(df: DataFrame, xml: str, path: str, name: str) -> DataFrame:
    """One row per text found at an XPath; rows without XML or without a match give none.

    A malformed text gives one row without a value, marked in the column ``rejected``.
    """
    rows = df.where(F.col(xml).isNotNull()).withColumn("rejected", malformed(F.col(xml)))
    found = F.when(F.col("rejected"), F.array(F.lit(None).cast("string"))).otherwise(F.xpath(F.col(xml), F.lit(path)))
    return rows.withColumn(name, F.explode(found)).drop(xml)


def xml_rows(df: DataFrame, xml: str, element: str, schema: T.StructType, below: tuple[str, int] | None = None) -> DataFrame:
    """The repeated elements of an XML text as rows with typed columns.

    ``below`` keeps the rows whose named column is under a bound. A malformed text gives one
    row without values, marked in the column ``rejected``, which no bound takes away. Each text is
    parsed once: values are taken as texts beside the parser's mark of a malformed record, so a
    value of another type is null and no fault of the text.
    """
    deep = [isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) for f in schema]
    read = T.StructType([f if nested else T.StructField(f.name, T.StringType()) for f, nested in zip(schema, deep)])
    wrapper = T.StructType([T.StructField(element, T.ArrayType(read)), T.StructField("_corrupt_record", T.StringType())])
    parsed = df.where(F.col(xml).isNotNull()).withColumn("_parsed", F.from_xml(F.col(xml), wrapper.simpleString()))
    rows = parsed.withColumn("rejected", F.col("_parsed._corrupt_record").isNotNull())
    none = F.array(F.lit(None).cast(read))
    rows = rows.withColumn("_record", F.explode(F.when(F.col("rejected"), none).otherwise(F.col("_parsed")[element])))
    fields = [
        F.col(f"_record.{f.name}").alias(f.name) if nested else F.col(f"_record.{f.name}").try_cast(f.dataType).alias(f.name)
        for f, nested in zip(schema, deep)]
    out = rows.select(*[c for c in df.columns if c != xml], "rejected", *fields)
    return out if below is None else out.where(F.col("rejected") | (F.col(below[0]) < below[1]))


def _affixed(body: Column, prefix: str | None, suffix: str | None) -> Column:
    return F.concat(F.lit(prefix or ""), F.coalesce(body, F.lit("")), F.lit(suffix or ""))


def join_list(values: Column, delimiter: str | None, prefix: str | None = None, suffix: str | None = None) -> Column:
    """An array as one text. A null element adds only its delimiter. A null array without
    affixes gives null, an empty array an empty text."""
    body = F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit(""))), delimiter or "")
    whole = _affixed(body, prefix, suffix)
    return whole if prefix is not None or suffix is not None else F.when(values.isNotNull(), whole)


def string_agg_affix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    out: str,
    delimiter: str | None,
    prefix: str | None = None,
    suffix: str | None = None,
    hot_rows: int | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """The ordered texts of each key as one text; a text of length zero becomes null.

    A null text adds no characters but keeps its delimiter. A hot key is joined chunk by
    chunk in parallel; only the chunk texts meet in one task.
    """
    rows, split = split_hot_groups(df, keys, order, hot_rows, chunks)
    gap = delimiter or ""

    def joined(place: Column, value: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(place.alias("_at"), F.coalesce(value, F.lit("")).alias("_text"))))
        return F.array_join(F.transform(listed, lambda e: e["_text"]), gap)

    parts = rows.groupBy(*keys, CHUNK).agg(joined(comparable(df, order), text).alias("_part"))
    whole = parts.groupBy(*keys).agg(joined(F.col(CHUNK), "_part").alias("_part")) if split else parts
    return whole.select(*keys, null_if_blank(_affixed(F.col("_part"), prefix, suffix)).alias(out))


def match_text_or_tag(
    baselines: DataFrame, texts: DataFrame, tags: Sequence[str], text: str = "sql_text", description: str = "description"
) -> DataFrame:
    """Baselines whose whole text equals one of the texts, or whose description has a tag.

    Texts are compared by SHA-256, so only digests are shuffled. The tag test is a filter of
    its own rather than one side of an OR-join; ``matched_text`` says which test a row passed.
    """
    wanted = texts.select(F.sha2(F.col(text), 256).alias("_digest")).distinct().withColumn("_same", F.lit(True))
    tagged = F.lit(False)
    for tag in tags:
        tagged = tagged | F.col(description).contains(tag)
    rows = baselines.withColumn("_digest", F.sha2(F.col(text), 256)).join(wanted, "_digest", "left")
    return (
        rows.withColumn("matched_text", F.coalesce("_same", F.lit(False)))
        .where(F.col("matched_text") | F.coalesce(tagged, F.lit(False)))
        .drop("_digest", "_same")
    )


def lookup_text(texts: DataFrame, identifier: str, value: str, text: str = "sql_text") -> DataFrame:
    """The text of one id, as a one-row frame; raises when there is none."""
    if not value.isalnum() or value != value.lower():
        raise ValueError(f"invalid id: {value!r}")
    found = texts.where(F.col(identifier) == value).select(text).limit(1)
    if found.isEmpty():
        raise LookupError(f"no text with id {value!r}")
    return found


def manual_baselines(baselines: DataFrame, texts: DataFrame, text: str = "sql_text") -> DataFrame:
    """Manually created baselines of the given texts."""
    return match_text_or_tag(baselines.where(F.col("origin").like("MANUAL%")), texts, (), text)
