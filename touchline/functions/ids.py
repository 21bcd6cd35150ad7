"""Identifier and number hygiene as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN as null, so that comparisons and minima behave."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def clean_id(c: Column | str) -> Column:
    """Null becomes '', a whole number in any spelling ('7', '7.0') its integer form, else trimmed text."""
    text = F.trim(col(c).cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(9e15)) & (number == F.floor(number))
    return F.when(text.isNull(), "").when(whole, number.cast("long").cast("string")).otherwise(text)


def plain_id(c: Column | str) -> Column:
    """Trimmed, without a trailing '.0'; null where nothing is left."""
    text = F.regexp_replace(F.trim(col(c)), r"\.0$", "")
    return F.when(text != "", text)


def numbered_id(c: Column | str) -> Column:
    """Case, surrounding blanks and leading zeros of the number don't matter; empty forms are null."""
    text = F.lower(F.regexp_replace(col(c), r"^\s+|\s+$", ""))
    text = F.regexp_replace(text, r"(^|[^0-9])0+(?=[0-9])", "$1")
    return F.when(~text.isin("", "none", "nan", "null"), text)


def words_state(c: Column | str) -> Column:
    """Lower case, trimmed, words joined by '_', without a trailing '.0'; null where empty."""
    text = F.regexp_replace(F.lower(F.trim(col(c))), r"[\s_-]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, r"^_+|_+$", ""), r"\.0$", "")
    return F.when(text != "", text)
