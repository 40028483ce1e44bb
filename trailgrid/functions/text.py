"""Text column functions: missing values, name tokens, crossing phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: spellings of a missing value
MISSING = ("", "NA", "NaN", "nan", "NaT", "None")


def or_null(text: Column) -> Column:
    """Trimmed text; NULL for any spelling of a missing value."""
    value = F.trim(text.cast("string"))
    return F.when(~value.isin(*MISSING), value)


def number(value: Column) -> Column:
    """A finite double, else NULL (NaN would pass every comparison)."""
    x = value.try_cast("double") if hasattr(value, "try_cast") else value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def file_token(text: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` only; other runs become one ``_``."""
    return F.regexp_replace(F.trim(text), r"[^\w\-]+", "_")


def blank_bucket(text: Column) -> Column:
    """The trimmed text, ``(blank)`` if missing."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("(blank)"))


def crossing_phrase(road: Column, highway: Column) -> Column:
    return F.when(road & highway, "road and highway").when(highway, "highway").when(road, "road").otherwise("")


def note_with_crossing(note: Column, phrase: Column) -> Column:
    """The note with one crossing phrase at its end, whatever it held before."""
    bare = F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), r"\s*\[crosses [a-z ]+\]", ""))
    return F.when(phrase == "", bare).otherwise(F.trim(F.concat_ws(" ", F.nullif(bare, F.lit("")), F.concat(F.lit("[crosses "), phrase, F.lit("]")))))


def display_value(x: Column) -> Column:
    """A number with as many decimals as its size asks for."""
    return F.when(F.abs(x) >= 1000, F.format_number(x, 0)).when(F.abs(x) >= 1, F.format_number(x, 1)).otherwise(F.format_number(x, 3))


def contour_opacity(level: Column, volume: bool = False) -> Column:
    shown = 100 - level if volume else level
    return F.least(F.lit(0.6), F.greatest(F.lit(0.12), shown / 150))
