"""jq functions as Columns: strings, arrays, objects (maps), numbers and dates.

JSON text is read with from_json into typed columns (maps keep key order);
programs whose shape is unknown go through ``weft.plans.jq``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.patterns import quote

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_downcase(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def ascii_upcase(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def ltrimstr(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)


def rtrimstr(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix) & (F.lit(suffix) != ""), F.substr(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def split(s: Column, separator: str) -> Column:
    """Parts between literal separators; an empty text has none, an empty separator gives code points."""
    parts = F.filter(F.split(s, ""), lambda c: c != "") if separator == "" else F.split(s, quote(separator))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(parts)


def join(a: Column, separator: str) -> Column:
    """Elements as text with separators; null counts as empty."""
    return F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit(""))), separator)


def explode_points(s: Column) -> Column:
    """Code points of a text."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))


def indices(s: Column, needle: str) -> Column:
    """Places (from 0) of a text, overlaps included."""
    size = len(needle)
    return F.when(F.length(s) < size, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(F.length(s) - size, F.lit(0))), lambda i: F.substr(s, i + 1, F.lit(size)) == needle))


def slice_text(s: Column, start: int | None, end: int | None) -> Column:
    """.[start:end] of a text; negative bounds count from the end."""
    n = F.length(s)
    a = F.lit(0) if start is None else F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if end is None else F.least(F.lit(end), n) if end >= 0 else n + end
    return F.when(b > a, F.substr(s, a + 1, b - a)).otherwise("")


def slice_array(x: Column, start: int | None, end: int | None) -> Column:
    """.[start:end] of an array; negative bounds count from the end."""
    n = F.size(x)
    a = F.lit(0) if start is None else F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if end is None else F.least(F.lit(end), n) if end >= 0 else n + end
    return F.slice(x, a + 1, F.greatest(b - a, F.lit(0)))


def at(x: Column, i: int) -> Column:
    """.[i]: null beyond either end."""
    return F.get(x, F.lit(i)) if i >= 0 else F.get(x, F.size(x) + i)


def without(a: Column, b: Column) -> Column:
    """a - b: every element that b has is removed; the others keep order and number."""
    return F.filter(a, lambda x: ~F.coalesce(F.array_contains(b, x), F.lit(False)))


def add(x: Column, zero) -> Column:
    """Sum of an array of numbers; null of an empty one."""
    return F.when(F.size(x) == 0, F.lit(None)).otherwise(F.aggregate(x, zero, lambda a, v: a + v))


def unique(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def flatten(x: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        x = F.flatten(x)
    return x


def merge(a: Column, b: Column) -> Column:
    """a + b of objects: the right side wins; keys keep their first place."""
    left = F.map_from_entries(F.transform(F.map_entries(a), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(b, e["key"]), e["value"]).alias("value"))))
    return F.map_concat(left, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def truthy(b: Column) -> Column:
    """Only null and false are not."""
    return F.coalesce(b, F.lit(False))


def alternative(a: Column, b: Column) -> Column:
    """a // b: b where a is null or false."""
    return F.coalesce(a, b)


def modulo(a: Column, b: Column) -> Column:
    """% on truncated integers with the sign of the dividend; null for a zero divisor."""
    x, y = a.cast("long"), F.abs(b.cast("long"))
    return F.try_mod(x, y)


def round_half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def encode_base64(s: Column) -> Column:
    return F.replace(F.base64(s.cast("binary")), F.lit("\r\n"), F.lit(""))


def wrap_text(s: Column, width: int = 76) -> Column:
    """Lines of a width, as base64 -w writes them."""
    return F.regexp_replace(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), "\n$", "")


def uri(s: Column) -> Column:
    """@uri: everything but unreserved characters as %XX."""
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def shell(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def csv(*cols: tuple[Column, bool]) -> Column:
    """@csv of (column, is text): texts are quoted, null is empty."""
    return F.concat_ws(",", *(F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) if text else c.cast("string"), F.lit("")) for c, text in cols))


def tsv(*cols: Column) -> Column:
    """@tsv: backslash, tab, newline and return are escaped."""
    out = []
    for c in cols:
        c = F.coalesce(c.cast("string"), F.lit(""))
        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(a), F.lit(b))
        out.append(c)
    return F.concat_ws("\t", *out)


def gmtime(seconds: Column) -> Column:
    """Broken-down UTC time: year, month from 0, day, hours, minutes, seconds, weekday from Sunday, day of the year from 0."""
    t = F.timestamp_seconds(seconds)
    return F.array(F.year(t), F.month(t) - 1, F.day(t), F.hour(t), F.minute(t), F.second(t), F.dayofweek(t) - 1, F.dayofyear(t) - 1)


#: strftime letters and the Java patterns with the same meaning.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "e": "d", "Z": "'UTC'", "z": "'+0000'"}


def java_date_pattern(fmt: str) -> str:
    """A Java date pattern of a strftime format."""
    out, literal, i = "", "", 0

    def flush() -> str:
        return "'" + literal.replace("'", "''") + "'" if literal else ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] == "%":
                literal += "%"
            else:
                out += flush() + STRFTIME[fmt[i + 1]]
                literal = ""
            i += 2
        else:
            literal += fmt[i]
            i += 1
    return out + flush()


def strftime(t: Column, fmt: str) -> Column:
    return F.date_format(t, java_date_pattern(fmt))


def strptime(s: Column, fmt: str) -> Column:
    """Seconds since the epoch of a UTC time text; null if it does not fit."""
    return F.unix_timestamp(F.try_to_timestamp(s, F.lit(java_date_pattern(fmt))))


def todate(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sort_key(rank: Column, num: Column, text: Column) -> Column:
    """A comparable key of the total order: null, false, true, numbers (NaN first), texts."""
    return F.struct(rank.alias("rank"), F.when(F.isnan(num), F.lit(float("-inf"))).otherwise(num).alias("num"), (~F.isnan(num)).alias("nan_first"), text.alias("text"))
