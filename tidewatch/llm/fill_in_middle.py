"""Fill-in-middle transformation by counted quantifiers of regular expressions, with DataFrame operations only.

``regexp_count`` gives a text's number of code points n. Two hashes of its key choose the two
cuts; a pattern made for the row, ``(.{a}+)(.{b - a}+)(.*+)``, captures prefix, middle and
suffix in one match, and its replacement text puts them in the order of the row's form. The
quantifiers are possessive, so nothing is tried twice and a match takes linear time and no
recursion however long the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points counted by one match; the rest of a text, fewer than these, is counted one by one.
STRIDE = 1000
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def code_points(text: Column) -> Column:
    """Number of code points of a text, by ``regexp_count``.

    Whole strides are counted first and then the units after them, so that the matches held in
    memory are a copy of the text and at most ``STRIDE`` short ones, not one object a character.
    """
    strides = F.regexp_count(text, F.lit(f"(?s).{{{STRIDE}}}+"))
    tail = F.regexp_replace(text, F.lit(rf"(?s)\A(?:.{{{STRIDE}}}+)++"), F.lit(""))
    return (strides * STRIDE + F.regexp_count(tail, F.lit("(?s)."))).cast("long")


def _quoted(marker: str) -> str:
    """A pattern that matches the marker itself."""
    return "".join(c if c.isalnum() else "\\" + c if c.isascii() else c for c in marker)


def _literal(marker: str) -> str:
    """The marker in a replacement text."""
    return marker.replace("\\", "\\\\").replace("$", "\\$")


def _check(markers: tuple[str, str, str]) -> None:
    """Markers must not overlap one another: then an output holds each of them once, where it was put."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            if not a or (i != j and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers overlap or are empty: {markers}")


def hashed_groups(key: str, seed: str, count: int) -> list[Column]:
    """The first groups of 8 hexadecimal digits of the SHA-256 of ``<seed>:<key>``, as numbers; a null key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(count)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", transformed_percent: int = 90, spm_percent: int = 20,
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
) -> DataFrame:
    """The columns of ``docs`` and n, form, prefix_chars, middle_chars and output.

    ``plain`` leaves the text as it is; ``psm`` is prefix, suffix, middle, each behind its
    marker (``markers``: of prefix, suffix, middle); ``spm`` begins with the suffix. Which form a
    document takes and where it is cut follow from its key and ``seed`` alone and from n, so reruns
    and repeated rows agree. Plain are texts that are empty or hold a marker, and by chance all
    but ``transformed_percent``; their prefix_chars and middle_chars are null. A null text counts
    as empty, a null key as the empty key. Columns of ``docs`` that are named like a result are
    replaced by it; others come along whatever their names. An empty table gives no rows.
    """
    _check(markers)
    before, after, between = (F.lit(_literal(m)) for m in markers)
    others = [c for c in docs.columns if c.lower() not in RESULTS]
    h = hashed_groups(key, seed, 4)
    frame = docs.select(
        F.struct(*others).alias("row") if others else F.lit(None).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        *[x.alias(f"_h{i}") for i, x in enumerate(h, 1)])
    frame = frame.withColumn("_n", code_points(F.col("_text")))
    cuts = [F.pmod(F.col(f"_h{i}"), F.col("_n") + 1) for i in (1, 2)]
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(F.col("_text"), F.lit(m))
    plain = (F.col("_n") == 0) | marked | (F.col("_h3") % 100 >= transformed_percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    frame = frame.withColumns({"_a": F.least(*cuts), "_b": F.greatest(*cuts), "_form": form})
    pattern = F.concat(F.lit(r"(?s)\A(.{"), F.col("_a").cast("string"), F.lit("}+)(.{"), (F.col("_b") - F.col("_a")).cast("string"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("_form") == "psm", F.concat(before, F.lit("$1"), after, F.lit("$3"), between, F.lit("$2"))).otherwise(
        F.concat(after, F.lit("$3"), before, F.lit("$1"), between, F.lit("$2")))
    moved = F.col("_form") != "plain"
    return frame.select(
        *[F.col("row").getField(c).alias(c) for c in others], F.col("_n").alias("n"), F.col("_form").alias("form"),
        F.when(moved, F.col("_a")).alias("prefix_chars"), F.when(moved, F.col("_b") - F.col("_a")).alias("middle_chars"),
        F.when(moved, F.regexp_replace(F.col("_text"), pattern, order)).otherwise(F.col("_text")).alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made from, rebuilt from output and form alone."""
    _check(markers)
    prefix, suffix, middle = map(_quoted, markers)
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{prefix}(.*){suffix}(.*){middle}(.*)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{suffix}(.*){prefix}(.*){middle}(.*)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


FILL_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
numbered AS (
  SELECT *, length(body) AS n, ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
    ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM docs),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbered),
parts AS (SELECT *, substr(body, 1, a) AS p, substr(body, a + 1, b - a) AS m, substr(body, b + 1) AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""
