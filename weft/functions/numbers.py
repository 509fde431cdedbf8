"""Number formats and bit arithmetic of the command-line tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(size: Column) -> Column:
    """Powers of 1024, rounded up: one decimal below ten."""
    out = F.format_string("%d", size.cast("long"))
    for i, unit in enumerate("KMGTPE", 1):
        scaled = size / float(1024**i)
        tenth = F.ceil(scaled * 10) / 10.0
        text = F.when(tenth < 10, F.concat(F.format_string("%.1f", tenth), F.lit(unit))).otherwise(F.concat(F.ceil(scaled).cast("string"), F.lit(unit)))
        out = F.when(size >= 1024**i, text).otherwise(out)
    return out


def change_mode(mode: Column, clause: str) -> Column:
    """A symbolic permission clause such as u+x, go-w or a=r applied to mode bits."""
    who, op, what = "", "", ""
    for i, c in enumerate(clause):
        if c in "+-=":
            who, op, what = clause[:i] or "a", c, clause[i + 1 :]
            break
    shifts = {"u": 6, "g": 3, "o": 0}
    bits = sum({"r": 4, "w": 2, "x": 1}[p] for p in set(what))
    people = "ugo" if "a" in who else who
    mask = sum(bits << shifts[w] for w in people)
    every = sum(7 << shifts[w] for w in people)
    if op == "+":
        return mode.bitwiseOR(F.lit(mask))
    if op == "-":
        return mode.bitwiseAND(F.lit(~mask & 0o7777))
    return mode.bitwiseAND(F.lit(~every & 0o7777)).bitwiseOR(F.lit(mask))


def equal_width(value: Column, width: int) -> Column:
    """seq -w: zeros in front up to a width, behind a sign."""
    text = value.cast("string")
    return F.when(text.startswith("-"), F.concat(F.lit("-"), F.lpad(F.substr(text, F.lit(2)), width - 1, "0"))).otherwise(F.lpad(text, width, "0"))
