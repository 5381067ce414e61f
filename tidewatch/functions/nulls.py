"""Null-aware expressions whose rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The argument texts that count as "yes", in any letter case.
TRUTHY = ("y", "yes", "true", "t", "1")


def is_truthy(value: str | bool | None) -> bool:
    """Python-side reading of a yes/no argument."""
    if isinstance(value, bool):
        return value
    return value is not None and value.lower() in TRUTHY


def not_true(condition: Column) -> Column:
    """True where the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def text_concat(*parts: Column | str) -> Column:
    """Concatenation in which a null part adds nothing. Plain strings are literals."""
    nothing = F.lit("")
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), nothing) for p in parts])


def unless_null(test: Column, value: Column) -> Column:
    """The value where the test column is present, else null."""
    return F.when(test.isNotNull(), value)


def null_if_blank(text: Column) -> Column:
    """Null for the empty string, as a failed regular-expression match should read."""
    return F.nullif(text, F.lit(""))


def quote_name(name: Column) -> Column:
    """An identifier safe to place in generated text.

    Already quoted names stay; all-capital plain names become lower case; other names are
    quoted. A name that cannot be written safely raises an error.
    """
    quoted = name.rlike(r'^"[^"]+"(\."[^"]+")*$')
    plain = (name == F.upper(name)) & name.rlike(r"^[A-Z][A-Z0-9_$#]*$")
    quotable = (name != F.upper(name)) & ~name.contains('"')
    return (
        F.when(name.isNull() | quoted, name)
        .when(plain, F.lower(name))
        .when(quotable, F.concat(F.lit('"'), name, F.lit('"')))
        .otherwise(F.raise_error(F.concat(F.lit("not a safe name: "), name)).cast("string"))
    )
