"""The text algebra: line search, cutting, translating, ordering and counting as lazy DataFrame transforms.

Operators that look at neighbouring lines of a text (context, runs, numbering,
heads and tails) work on the array of its lines with higher-order functions:
a text is one row, so none of them shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import lines, with_lines
from .patterns import is_literal, java_pattern, quote, search_pattern


def matches(col: Column, *patterns: str, **options) -> Column:
    """Whether any pattern occurs; a single literal becomes containment, which is cheaper than a match."""
    plain = not any(options.get(k) for k in ("word", "whole", "ignore_case"))
    if len(patterns) == 1 and plain and (options.get("fixed") or is_literal(patterns[0])):
        return col.contains(patterns[0])
    return col.rlike(search_pattern(list(patterns), **options))


def matches_somewhere(text: Column, *patterns: str, **options) -> Column | None:
    """A condition that every text with a matching line meets: the same match over the whole text. None where an anchor, a class that takes newlines in or a match of whole lines could differ."""
    if options.get("whole") or options.get("word") or any("\n" in p for p in patterns):
        return None
    if not options.get("fixed") and any(set(p) & set("^$\\") or "[^" in p for p in patterns):
        return None
    return matches(text, *patterns, **options)


def grep(df: DataFrame, *patterns: str, keys: tuple[str, ...] = ("doc_id",), invert: bool = False, **options) -> DataFrame:
    """Lines that match (or do not): keys, ln, line. Texts without a match are left out before they are split into lines."""
    if not invert and (whole := matches_somewhere(F.col("text"), *patterns, **options)) is not None:
        df = df.where(whole)
    hit = matches(F.col("line"), *patterns, **options)
    return lines(df, *keys).where(~hit if invert else hit)


def grep_count(df: DataFrame, *patterns: str, keys: tuple[str, ...] = ("doc_id",), zeros: bool = True, **options) -> DataFrame:
    """Matching lines of each text, counted inside its row; zeros keeps texts without any."""
    if not zeros and (whole := matches_somewhere(F.col("text"), *patterns, **options)) is not None:
        df = df.where(whole)
    n = F.size(F.filter("lines", lambda x: matches(x, *patterns, **options))).cast("long")
    out = with_lines(df).select(*keys, n.alias("n"))
    return out if zeros else out.where("n > 0")


def only_matching(df: DataFrame, pattern: str, keys: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """A row for each non-empty match: keys, ln, k (number within the line), match."""
    found = F.regexp_extract_all("line", F.lit(search_pattern([pattern], **options)), F.lit(0))
    return lines(df, *keys).select(*keys, "ln", F.posexplode(found).alias("k", "match")).where("match <> ''").select(*keys, "ln", (F.col("k") + 1).cast("long").alias("k"), "match")


def files_with(df: DataFrame, pattern: str, keys: tuple[str, ...] = ("doc_id",), without: bool = False, **options) -> DataFrame:
    """Keys of texts that have a matching line, or have none; a literal without a newline is looked for in the whole text."""
    hit = matches(F.col("text"), pattern, **options) if is_literal(pattern) and not options else F.exists("lines", lambda x: matches(x, pattern, **options))
    return with_lines(df).where(~hit if without else hit).select(*keys)


def context(df: DataFrame, pattern: str, before: int, after: int, keys: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """Lines within `before` lines ahead of a match or `after` lines behind one: keys, ln, line, hit, grp (number of the group of touching lines)."""
    marked = with_lines(df).select(*keys, "lines", F.transform("lines", lambda x: matches(x, pattern, **options)).alias("hits"))
    near = F.expr(f"transform(hits, (h, i) -> exists(slice(hits, greatest(i + 1 - {after}, 1), least(i + 1 + {before}, size(hits)) - greatest(i + 1 - {after}, 1) + 1), x -> x))")
    flagged = marked.where(F.exists("hits", lambda h: h)).withColumn("near", near)
    # a group is a run of near lines: explode the groups, then the lines of each
    firsts = F.expr("filter(sequence(0, size(near) - 1), i -> near[i] and (i = 0 or not near[i - 1]))")
    lasts = F.expr("filter(sequence(0, size(near) - 1), i -> near[i] and (i = size(near) - 1 or not near[i + 1]))")
    groups = flagged.select(*keys, "lines", "hits", F.posexplode(F.arrays_zip(firsts.alias("a"), lasts.alias("b"))).alias("g", "r"))
    rows = groups.select(*keys, "lines", "hits", "g", F.explode(F.expr("sequence(r.a, r.b)")).alias("i"))
    return rows.select(*keys, (F.col("i") + 1).cast("long").alias("ln"), F.expr("lines[i]").alias("line"), F.expr("hits[i]").alias("hit"), (F.col("g") + 1).cast("long").alias("grp"))


def fields(line: Column, separator: str | None = None) -> Column:
    """Fields of a line: blank runs by default, else a literal separator; an empty line has none."""
    parts = F.split(F.trim(F.regexp_replace(line, r"[ \t\n]+", " ")), " ") if separator is None else F.split(line, quote(separator))
    return F.when(F.length(F.trim(line) if separator is None else line) == 0, F.array().cast("array<string>")).otherwise(parts)


def ranges(spec: str) -> list[tuple[int, int | None]]:
    """Merged, sorted ranges of a list such as 1,3-5,7-."""
    found = []
    for part in spec.split(","):
        a, dash, b = part.partition("-")
        found.append((int(a or 1), (int(b) if b else None) if dash else int(a)))
    out: list[tuple[int, int | None]] = []
    for a, b in sorted(found, key=lambda r: r[0]):
        if out and (out[-1][1] is None or a <= out[-1][1] + 1):
            out[-1] = (out[-1][0], None if out[-1][1] is None or b is None else max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _selected(i: Column, spec: str, complement: bool) -> Column:
    inside = F.lit(False)
    for a, b in ranges(spec):
        inside = inside | ((i >= a) if b is None else i.between(a, b))
    return ~inside if complement else inside


def cut_fields(line: Column, spec: str, delimiter: str = "\t", *, out: str | None = None, complement: bool = False, only_delimited: bool = False) -> Column:
    """Selected fields in input order; a line without the delimiter passes whole, or is null with only_delimited."""
    parts = F.split(line, quote(delimiter))
    kept = F.filter(parts, lambda x, i: _selected(i + 1, spec, complement))
    chosen = F.array_join(kept, delimiter if out is None else out)
    return F.when(F.size(parts) > 1, chosen).otherwise(F.lit(None) if only_delimited else line)


def cut_blank(line: Column, spec: str) -> Column:
    """Fields between runs of blanks, joined by tabs."""
    return cut_fields(F.regexp_replace(line, r"[ \t]+", "\t"), spec)


def cut_bytes(line: Column, spec: str) -> Column:
    """Selected bytes."""
    raw = F.encode(line, "UTF-8")
    parts = [F.substr(raw, F.lit(a), F.lit(2**31 - 1 if b is None else b - a + 1)) for a, b in ranges(spec)]
    return F.concat(*parts)


def expand_set(spec: str) -> str:
    """Members of a translation set: ranges, escapes and bracket classes, ASCII only."""
    classes = {"upper": (65, 90), "lower": (97, 122), "digit": (48, 57)}
    spec = re.sub(r"\[:(\w+):\]", lambda m: "".join(map(chr, range(classes[m[1]][0], classes[m[1]][1] + 1))) if m[1] in classes else "".join(c for c in map(chr, range(128)) if {"alpha": c.isalpha(), "alnum": c.isalnum(), "space": c in " \t\n\v\f\r", "punct": c.isprintable() and not c.isalnum() and c != " ", "blank": c in " \t"}[m[1]]), spec)
    spec = spec.replace(r"\n", "\n").replace(r"\t", "\t")
    return re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), spec, flags=re.S)


def tr(col: Column, from_: str, to: str | None = None, *, delete: bool = False, squeeze: bool = False, truncate: bool = False) -> Column:
    """Translate, delete and squeeze members of a set; the last member of the second set stands for missing ones."""
    a = expand_set(from_)
    if delete:
        return F.translate(col, a, "")
    b = expand_set(to) if to is not None else a
    if to is not None:
        if truncate:
            a = a[: len(b)]
        col = F.translate(col, a, (b + b[-1] * len(a))[: len(a)])
    return F.regexp_replace(col, "([" + "".join(quote(c) if c not in "-&~" else "\\" + c for c in b) + r"])\1+", "$1") if squeeze else col


def number_lines(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), first: int = 1, step: int = 1, nonempty: bool = True) -> DataFrame:
    """Numbered lines; empty ones get none with nonempty."""
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (F.get("lines", i) != "") | F.lit(not nonempty))
    arr = with_lines(df).where(F.size("lines") > 0).withColumn("at", at)
    counted = F.expr("transform(at, (i, k) -> struct(i as i, k as k))")
    blank = F.expr("transform(filter(sequence(0, size(lines) - 1), i -> lines[i] = ''), i -> struct(i as i, cast(null as int) as k))") if nonempty else F.expr("filter(transform(at, (i, k) -> struct(i as i, k as k)), x -> false)")
    rows = arr.select(*keys, "lines", F.explode(F.concat(counted, blank)).alias("r"))
    return rows.select(*keys, (F.col("r.i") + 1).cast("long").alias("ln"), (F.col("r.k") * step + first).cast("long").alias("number"), F.expr("lines[r.i]").alias("line"))


def run_lengths(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), by=None) -> DataFrame:
    """Adjacent equal lines as one row: keys, run, line (the first), n. `by` gives the value that is compared."""
    by = by or (lambda x: x)
    arr = with_lines(df).withColumn("seen", F.transform("lines", by))
    starts = F.expr("filter(sequence(0, size(seen) - 1), i -> i = 0 or seen[i] <> seen[i - 1])")
    arr = arr.where(F.size("lines") > 0).withColumn("starts", starts)
    rows = arr.select(*keys, "lines", "starts", F.posexplode("starts").alias("k", "at"))
    until = F.expr("coalesce(get(starts, k + 1), size(lines))")
    return rows.select(*keys, (F.col("k") + 1).cast("long").alias("run"), F.expr("get(lines, at)").alias("line"), (until - F.col("at")).cast("long").alias("n"))


def squeeze_blank(df: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines with each run of empty ones reduced to one."""
    kept = F.filter("lines", lambda x, i: (x != "") | (i == 0) | (F.get("lines", i - 1) != ""))
    return with_lines(df).select(*keys, F.posexplode(kept).alias("pos", "line")).select(*keys, (F.col("pos") + 1).cast("long").alias("ln"), "line")


def head(df: DataFrame, n: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """First n lines of each text."""
    return with_lines(df).select(*keys, F.posexplode(F.slice("lines", 1, n)).alias("pos", "line")).select(*keys, (F.col("pos") + 1).cast("long").alias("ln"), "line")


def tail(df: DataFrame, n: int, keys: tuple[str, ...] = ("doc_id",), from_line: bool = False) -> DataFrame:
    """Last n lines of each text, or those from line n on."""
    start = F.lit(n) if from_line else F.greatest(F.size("lines") - n + 1, F.lit(1))
    part = F.slice(F.col("lines"), start, F.greatest(F.size("lines") - start + 1, F.lit(0)))
    return with_lines(df).withColumn("start", start).select(*keys, "start", F.posexplode(part).alias("pos", "line")).select(*keys, (F.col("pos") + F.col("start")).cast("long").alias("ln"), "line")


def wc(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Newlines, words, characters and bytes of each text."""
    t = F.col(text)
    words = F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+"))
    return df.select(*keys, (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("newlines"), words.cast("long").alias("words"), F.char_length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"))


def substitute(col: Column, pattern: str, replacement: str, *, everywhere: bool = False, ignore_case: bool = False, nth: int = 1, basic: bool = True) -> Column:
    """sed's s command: the first, n-th or every match; & and \\1 to \\9 stand for the match and its groups."""
    java = ("(?i)" if ignore_case else "") + java_pattern(pattern, basic)
    new, i = "", 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\" and i + 1 < len(replacement):
            d = replacement[i + 1]
            new += f"${d}" if d.isdigit() else "\\$" if d == "$" else d if d != "\\" else "\\\\"
            i += 1
        else:
            new += "$0" if c == "&" else "\\$" if c == "$" else c
        i += 1
    if everywhere and nth == 1:
        return F.regexp_replace(col, java, new)
    # up to the n-th match, lazily: what lies before it is kept as a group
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 2}" if m[1] != "0" else "$2", new)
    head_ = rf"(?s)^(.*?(?:{java}).*?){{{nth - 1}}}" if nth > 1 else ""
    if nth == 1:
        return F.regexp_replace(col, rf"(?s)^(.*?)({java})", "$1" + shifted)
    return F.regexp_replace(col, rf"(?s)^((?:.*?(?:{java})){{{nth - 1}}}.*?)({java})", "$1" + shifted) if head_ else col


def sort_rank(df: DataFrame, keys: tuple[str, ...], order: list[Column], name: str = "rank") -> DataFrame:
    """Rank of each row within its key by the given order (a relation has no order of its own)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def leading_number(col: Column) -> Column:
    """sort -n: the exact decimal a line starts with, else 0."""
    return F.coalesce(F.regexp_extract(col, r"^[ \t]*(-?[0-9]+(?:\.[0-9]*)?|-?\.[0-9]+)", 1).try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))


def human_number(col: Column) -> tuple[Column, Column]:
    """sort -h: rank of sign and unit, then the value."""
    number = F.coalesce(F.regexp_extract(col, r"^[ \t]*(-?[0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(0.0))
    unit = F.instr(F.lit("KMGTPEZYRQ"), F.upper(F.regexp_extract(col, r"^[ \t]*-?[0-9]*\.?[0-9]+([KkMGTPEZYRQ])", 1)))
    unit = F.when(F.regexp_extract(col, r"^[ \t]*-?[0-9]*\.?[0-9]+([KkMGTPEZYRQ])", 1) == "", 0).otherwise(unit)
    return F.signum(number) * (unit + 1), number


def version_key(col: Column) -> Column:
    """sort -V: runs of other characters and of digits in turn; ~ before the end, the end before letters, letters before the rest."""

    def ranked(text: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(text, "([^A-Za-z~])", "3$1"), "([A-Za-z])", "2$1")
        return F.concat(F.regexp_replace(marked, "~", "0~"), F.lit("1"))

    runs = F.regexp_extract_all(col, F.lit("([^0-9]*)([0-9]*)"), F.lit(0))
    return F.transform(runs, lambda x: F.struct(ranked(F.regexp_extract(x, "^([^0-9]*)", 1)).alias("t"), F.coalesce(F.regexp_extract(x, "([0-9]*)$", 1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("n")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def first_disorder(df: DataFrame, key: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of the first line that sorts below the one before it, for texts that are not sorted."""
    at = F.expr("filter(sequence(1, size(lines) - 1), i -> lines[i] < lines[i - 1])")
    arr = with_lines(df).where(F.size("lines") > 1)
    return arr.select(*keys, (F.get(at, F.lit(0)) + 1).cast("long").alias(key)).where(F.col(key).isNotNull())
