"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def whole(col: Column | str) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """Array of the words, in order. Splitting is cheaper than matching; only the ends can be empty."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def packed(df: DataFrame, **cols: Column) -> DataFrame:
    """The row of ``df`` as one struct ``_row`` beside the named expressions, so that no name can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(e.alias(k) for k, e in cols.items()))


def unpacked(df: DataFrame, columns: list[str], **cols: Column) -> DataFrame:
    """The columns of ``_row`` with the named expressions after them; these win over columns of the same name."""
    return df.select(*(F.col(f"_row.`{c}`").alias(c) for c in columns if c not in cols), *(e.alias(k) for k, e in cols.items()))
