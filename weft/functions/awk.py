"""awk value rules and string functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[ \t\n]*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def number(value: Column) -> Column:
    """The number a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(value, NUMBER, 1).try_cast("double"), F.lit(0.0))


def looks_numeric(value: Column) -> Column:
    """Whether a field as a whole is a number (blanks around it allowed)."""
    return value.rlike(NUMBER + r"[ \t\n]*$")


def compare(left: Column, right: Column, left_is_text: bool = False, right_is_text: bool = False) -> Column:
    """-1, 0 or 1: as numbers if both sides are fields that look like numbers, else as texts."""
    as_text = F.when(left < right, -1).when(left > right, 1).otherwise(0)
    if left_is_text or right_is_text:
        return as_text
    a, b = number(left), number(right)
    return F.when(looks_numeric(left) & looks_numeric(right), F.when(a < b, -1).when(a > b, 1).otherwise(0)).otherwise(as_text)


def to_text(value: Column) -> Column:
    """A number as text: integers without a point, others with six significant digits and no trailing zeros."""
    magnitude = F.floor(F.log10(F.abs(value))).cast("int")
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.round(value * F.pow(F.lit(10.0), 5 - magnitude)) / F.pow(F.lit(10.0), 5 - magnitude)), "0+$", ""), r"\.$", "")
    return F.when(value == F.floor(value), F.format_string("%d", value.cast("long"))).otherwise(fixed)


def substr(value: Column, start: Column, length: Column | None = None) -> Column:
    """Characters from start (1-based), clipped to the text; rounding as in awk."""
    first = F.round(start)
    last = first + F.round(length) if length is not None else F.length(value) + 1
    a = F.greatest(first, F.lit(1))
    b = F.least(last, F.length(value) + 1)
    return F.when(b > a, F.substr(value, a.cast("int"), (b - a).cast("int"))).otherwise("")


def index(value: Column, needle: Column) -> Column:
    """First place of a text in another, 0 if it is not there."""
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise(F.instr(value, needle))


def split(value: Column, separator: str) -> Column:
    """Parts of a text; an empty text has none."""
    return F.when(F.length(value) == 0, F.array().cast("array<string>")).otherwise(F.split(value, separator))


def match(value: Column, pattern: str) -> tuple[Column, Column]:
    """RSTART and RLENGTH of the first match: 0 and -1 without one."""
    hit = value.rlike(pattern)
    found = F.regexp_extract(value, f"(?s)^(.*?)({pattern})", 2)
    before = F.regexp_extract(value, f"(?s)^(.*?)({pattern})", 1)
    return F.when(hit, F.length(before) + 1).otherwise(0), F.when(hit, F.length(found)).otherwise(-1)
