"""Text, time and label hygiene."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.ids import col

#: Texts that mean yes.
TRUE_WORDS = ("1", "true", "yes", "y", "live")


def minutes_seconds(seconds: Column | str) -> Column:
    """m:ss, truncated."""
    s = col(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def minutes_millis(seconds: Column | str) -> Column:
    """mm:ss.mmm"""
    ms = F.floor(F.greatest(col(seconds), F.lit(0.0)) * 1000 + 0.5).cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(F.pmod(ms, F.lit(60000)) / 1000), F.pmod(ms, F.lit(1000)))


def clock_seconds(text: Column | str) -> Column:
    """"HH:MM:SS.fff" (or any shorter form) as seconds; null where a part is no number."""
    return F.aggregate(F.transform(F.split(col(text), ":"), lambda p: p.try_cast("double")), F.lit(0.0), lambda a, p: a * 60 + p)


def plain(text: Column | str, default: str = "") -> Column:
    """Trimmed text, ``default`` where null or empty."""
    t = F.trim(col(text).cast("string"))
    return F.when(t.isNull() | (t == ""), default).otherwise(t)


def truth(text: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(text).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def mentions(text: Column | str, *words: str) -> Column:
    """Whether any of the words occurs, in any case."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


def hash_numbers(text: Column | str) -> Column:
    """All numbers written as "#3" in a note."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"#\s*(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def stem(path: Column | str) -> Column:
    """File name without folder and suffix."""
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/\\]*)$", 1), r"\.[^.]*$", "")
