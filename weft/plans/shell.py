"""A text pipeline in command form, planned into one lazy DataFrame.

``run(df, "grep -i the | cut -d ' ' -f 1,2 | sort | uniq -c")`` reads the lines
of a table (keys, ln, line) and composes the operators of
``weft.operators.text``; Catalyst plans the whole. Lines of different keys are
different files. Commands that need an order carry it in ln.

``find . -name '*.ts' | xargs grep -n TODO | head -20`` lists the files of the
table (their keys joined by /) and works on those that are listed. Pipelines
are joined by ``;``, ``&&`` and ``||``. Whatever a command does not know,
redirections among it, is an error and never passed over.
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import text as T
from ..operators.patterns import glob_pattern, search_pattern
from ..operators.version import closest
from ..sources.tables import lines
from ..streaming.incremental import COMMANDS
from .awk import awk
from .sed import sed

Stage = Callable[[DataFrame, tuple[str, ...], list[str]], DataFrame]


def parse_list(line: str) -> list[tuple[str, list[list[str]]]]:
    """Pipelines with what joins each to the one before it: "", ;, && or ||. Quotes keep all of these."""
    lexer = shlex.shlex(line, posix=True, punctuation_chars="|&;<>")
    lexer.whitespace_split = True
    lexer.commenters = ""
    out: list[tuple[str, list[list[str]]]] = [("", [[]])]
    for token in lexer:
        if token == "|":
            out[-1][1].append([])
        elif token in (";", "&&", "||"):
            out.append((token, [[]]))
        elif token and set(token) <= set("|&;<>"):
            raise ValueError(f"{token} is not supported: write results with weft.sources.sinks")
        else:
            out[-1][1][-1].append(token)
    if out[-1] == (";", [[]]):
        out.pop()
    if any(not s for _, stages in out for s in stages):
        raise ValueError(f"empty stage in {line!r}")
    return out


def parse(line: str) -> list[list[str]]:
    """Words of each stage of a single pipeline."""
    found = parse_list(line)
    if len(found) > 1:
        raise ValueError(f"more than one pipeline in {line!r}")
    return found[0][1]


#: Long names of short options, by command.
LONG = {
    "grep": {"ignore-case": "i", "invert-match": "v", "word-regexp": "w", "line-regexp": "x", "extended-regexp": "E", "fixed-strings": "F", "only-matching": "o", "count": "c", "line-number": "n", "files-with-matches": "l", "files-without-match": "L", "no-filename": "h", "with-filename": "H", "max-count": "m", "regexp": "e", "after-context": "A", "before-context": "B", "context": "C", "quiet": "q", "no-group-separator": "G"},
    "sort": {"numeric-sort": "n", "reverse": "r", "unique": "u", "ignore-case": "f", "ignore-leading-blanks": "b", "human-numeric-sort": "h", "version-sort": "V", "dictionary-order": "d", "stable": "s", "key": "k", "field-separator": "t"},
    "uniq": {"count": "c", "repeated": "d", "unique": "u", "ignore-case": "i"},
    "head": {"lines": "n", "bytes": "c"},
    "tail": {"lines": "n", "bytes": "c"},
    "wc": {"lines": "l", "words": "w", "chars": "m", "bytes": "c"},
    "cut": {"fields": "f", "delimiter": "d", "characters": "c", "bytes": "b", "only-delimited": "s"},
    "cat": {"number": "n", "number-nonblank": "b", "squeeze-blank": "s", "show-ends": "E", "show-tabs": "T", "show-nonprinting": "v", "show-all": "A"},
    "sed": {"quiet": "n", "silent": "n", "regexp-extended": "E", "expression": "e"},
    "tr": {"delete": "d", "squeeze-repeats": "s", "complement": "c", "truncate-set1": "t"},
}


def options(args: list[str], flags: str, valued: str, command: str = "", count: str = "") -> tuple[dict[str, str | bool | list[str]], list[str]]:
    """Short options: flags stand alone, valued ones take the rest of the word or the next one; long ones by name. -NUM is the option `count`, where there is one. Anything else is an error."""
    out: dict[str, str | bool | list[str]] = {}
    rest, i = [], 0

    def add(name: str, value: str | None) -> None:
        if name in valued:
            out.setdefault(name, []).append(value)  # type: ignore[union-attr]
        else:
            out[name] = True

    def after(i: int, name: str) -> str:
        if i >= len(args):
            raise ValueError(f"{command}: option -{name} needs a value")
        return args[i]

    while i < len(args):
        a = args[i]
        if a == "--":
            return out, rest + args[i + 1 :]
        if a.startswith("--"):
            name, eq, value = a[2:].partition("=")
            short = LONG.get(command, {}).get(name)
            if short is None or short not in flags + valued or (eq and short not in valued):
                raise ValueError(f"{command}: unknown option {a}")
            if short in valued and not eq:
                i += 1
                value = after(i, name)
            add(short, value)
        elif len(a) < 2 or a[0] != "-":
            rest.append(a)
        elif a[1:].isdigit() and count:
            add(count, a[1:])
        else:
            j = 1
            while j < len(a):
                if a[j] in valued:
                    value = a[j + 1 :]
                    if not value:
                        i += 1
                        value = after(i, a[j])
                    add(a[j], value)
                    break
                if a[j] not in flags:
                    raise ValueError(f"{command}: unknown option -{a[j]}")
                add(a[j], None)
                j += 1
        i += 1
    return out, rest


def _none(rest: list[str], command: str, most: int = 0) -> None:
    if len(rest) > most:
        raise ValueError(f"{command}: unexpected {rest[most]!r}")


def _path(keys: tuple[str, ...]) -> Column:
    """The name of a file: its keys joined by slashes."""
    return F.concat_ws("/", *(F.col(k).cast("string") for k in keys))


def _whole(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row for each file: keys and all, the array of its lines in order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]).alias("all"))


def _unwhole(df: DataFrame, keys: tuple[str, ...], col: str = "out") -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("ln", "line")).withColumn("ln", (F.col("ln") + 1).cast("long"))


def _renumber(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    return df.withColumn("ln", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def _grep(df, keys, args, several=False):
    o, rest = options(args, "ivwxEFoclLnhHqsG", "eABCm", "grep")
    if not o.get("e") and not rest:
        raise ValueError("grep: a pattern is missing")
    patterns = o.get("e") or [rest.pop(0)]
    _none(rest, "grep")
    how = {"fixed": "F" in o, "basic": "E" not in o, "word": "w" in o, "whole": "x" in o, "ignore_case": "i" in o}
    line = F.col("line")
    hit = T.matches(line, *patterns, **how)
    hit = ~hit if "v" in o else hit
    named = "H" in o or several and "h" not in o
    name = [_path(keys)] if named else []
    if "q" in o:
        return df.where(hit).limit(1).where(F.lit(False))
    if "l" in o or "L" in o:
        files = df.groupBy(*keys).agg(F.bool_or(hit).alias("_any")).where("_any" if "l" in o else "not _any")
        return files.select(*keys, F.lit(1).cast("long").alias("ln"), _path(keys).alias("line"))
    by_file = Window.partitionBy(*keys).orderBy("ln")
    if "m" in o:
        seen = F.sum(hit.cast("int")).over(by_file)
        df = df.withColumn("_seen", seen - hit.cast("int")).where(F.col("_seen") < int(o["m"][0])).drop("_seen")
    if "c" in o:
        n = F.count_if(hit).cast("string")
        return df.groupBy(*keys).agg(n.alias("line")).select(*keys, F.lit(1).cast("long").alias("ln"), F.concat_ws(":", *name, "line").alias("line"))
    number = [F.col("ln").cast("string")] if "n" in o else []
    if "o" in o:
        if "v" in o:
            return df.where(F.lit(False))
        found = F.regexp_extract_all(line, F.lit(search_pattern(patterns, **how)), F.lit(0))
        rows = df.select(*keys, "ln", F.posexplode(found).alias("k", "line")).where("line <> ''").withColumn("line", F.concat_ws(":", *name, *number, "line"))
        return _renumber(rows, keys, F.col("ln"), F.col("k")).drop("k")
    before, after = (int((o.get(x) or o.get("C") or ["0"])[0]) for x in "BA")
    if before or after:
        w = by_file.rowsBetween(-after, before)
        near = df.withColumn("_hit", hit).withColumn("_near", F.max(F.col("_hit").cast("int")).over(w)).where("_near = 1")
        shown = F.when(F.col("_hit"), F.concat_ws(":", *name, *number, "line")).otherwise(F.concat_ws("-", *name, *number, "line"))
        if "G" in o:
            return near.withColumn("line", shown).drop("_hit", "_near")
        # a line -- stands between groups that do not touch
        near = near.withColumn("_gap", (F.col("ln") - F.lag("ln").over(by_file)) > 1)
        rows = near.select(*keys, "ln", F.posexplode(F.when(F.col("_gap"), F.array(F.lit("--"), shown)).otherwise(F.array(shown))).alias("k", "line"))
        return _renumber(rows, keys, F.col("ln"), F.col("k")).drop("k")
    return df.where(hit).withColumn("line", F.concat_ws(":", *name, *number, "line") if name or number else line)


def _rg(df, keys, args, several=False):
    """grep -E in smart case: a pattern without upper case ignores case."""
    plain = [a for a in args if not a.startswith("-")]
    if "-S" in args or "--smart-case" in args:
        args = [a for a in args if a not in ("-S", "--smart-case")]
        if plain and plain[0] == plain[0].lower():
            args = ["-i", *args]
    return _grep(df, keys, ["-E", *args], several)


def _key(line: Column, spec: str, sep: str | None) -> tuple[Column, set[str]]:
    """The part of a line that a key F[.C][OPTS][,F[.C][OPTS]] names, and its options."""
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?([nrfbhVd]*)(?:,(\d+)(?:\.(\d+))?([nrfbhVd]*))?", spec)
    if not m or int(m[1]) == 0:
        raise ValueError(f"sort: invalid key {spec!r}")
    first, char, last, last_char = int(m[1]), int(m[2] or 1), int(m[4] or 0), int(m[5] or 0)
    flags = set(m[3] or "") | set(m[6] or "")
    if sep is None:  # a field takes the blanks before it along
        fields = F.regexp_extract_all(line, F.lit(r"[ \t]*[^ \t]+"), F.lit(0))
        glue = ""
    else:
        fields, glue = F.split(line, re.escape(sep), -1), sep
    if "b" in flags:
        fields = F.transform(fields, lambda x: F.regexp_replace(x, r"^[ \t]+", ""))

    def upto(n: int) -> Column:
        return F.array_join(F.slice(fields, 1, n), glue)

    # a key is a stretch of the line: from a character of its first field to one of its last
    start = F.when(F.size(fields) >= first, F.length(upto(first - 1)) + (len(glue) if first > 1 else 0) + char).otherwise(F.length(line) + 1)
    whole = F.array_join(fields, glue)
    if not last:
        return F.substr(whole, start), flags
    end = F.length(upto(last)) if not last_char else F.when(F.size(fields) >= last, F.least(F.length(upto(last - 1)) + (len(glue) if last > 1 else 0) + last_char, F.length(upto(last)))).otherwise(F.length(whole))
    return F.when(end >= start, F.substr(whole, start, end - start + 1)).otherwise(F.lit("")), flags


def _sort(df, keys, args):
    o, rest = options(args, "nrufbhsVd", "kt", "sort")
    _none(rest, "sort")
    line = F.col("line")
    if len((o.get("t") or ["x"])[0]) != 1:
        raise ValueError("sort: -t needs one character")
    sep = o["t"][0] if "t" in o else None
    own = {f for f in "nrfbhVd" if f in o}
    order: list[Column] = []
    for spec in o.get("k") or [""]:
        value, flags = _key(line, spec, sep) if spec else (line, set())
        flags = flags or own
        if "b" in flags:
            value = F.regexp_replace(value, r"^[ \t]+", "")
        if "d" in flags:
            value = F.regexp_replace(value, r"[^A-Za-z0-9 \t]", "")
        if "h" in flags:
            made = list(T.human_number(value))
        elif "V" in flags:
            made = [T.version_key(value)]
        else:
            made = [T.leading_number(value) if "n" in flags else F.upper(value) if "f" in flags else value]
        order += [c.desc() if "r" in flags else c for c in made]
    if "u" in o:
        plain = [F.expr("1")] if not order else [c for c in order]
        df = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*plain)))
        return _renumber(df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_g").orderBy("ln"))).where("_n = 1"), keys, F.col("_g")).drop("_n", "_g")
    tie = F.col("ln") if "s" in o else (line.desc() if "r" in o else line)
    return _renumber(df, keys, *order, tie, F.col("ln"))


def _uniq(df, keys, args):
    o, rest = options(args, "cdui", "", "uniq")
    _none(rest, "uniq")
    w = Window.partitionBy(*keys).orderBy("ln")
    value = F.lower("line") if "i" in o else F.col("line")
    opens = df.withColumn("_v", value).withColumn("_o", (~F.col("_v").eqNullSafe(F.lag("_v").over(w))).cast("int"))
    runs = opens.withColumn("_run", F.sum("_o").over(w)).groupBy(*keys, "_run").agg(F.min("ln").alias("ln"), F.min_by("line", "ln").alias("line"), F.count("*").alias("_n")).drop("_run")
    if "d" in o:
        runs = runs.where("_n > 1")
    if "u" in o:
        runs = runs.where("_n = 1")
    if "c" in o:
        runs = runs.withColumn("line", F.format_string("%7d %s", "_n", "line"))
    return _renumber(runs.drop("_n"), keys, F.col("ln"))


def _cut(df, keys, args):
    o, rest = options(args, "sw", "dfcb", "cut")
    _none(rest, "cut")
    if not any(x in o for x in "fcb"):
        raise ValueError("cut: a list is missing")
    line = F.col("line")
    if "w" in o:
        out = T.cut_blank(line, o["f"][0])
    elif "f" in o:
        out = T.cut_fields(line, o["f"][0], (o.get("d") or ["\t"])[0], only_delimited="s" in o)
    else:
        out = T.cut_bytes(line, (o.get("b") or o.get("c"))[0]).cast("string")
    return df.withColumn("line", out).where("line is not null")


def _tr(df, keys, args):
    o, sets = options(args, "dst", "", "tr")
    if not sets or len(sets) > 2:
        raise ValueError("tr: one or two sets")
    return df.withColumn("line", T.tr(F.col("line"), sets[0], sets[1] if len(sets) > 1 else None, delete="d" in o, squeeze="s" in o, truncate="t" in o))


def _bytes(df: DataFrame, keys: tuple[str, ...], part: Callable[[Column], Column]) -> DataFrame:
    """Files cut by bytes: the lines of the part that is left."""
    text = F.concat(F.array_join("all", "\n"), F.lit("\n")).cast("binary")
    return lines(_whole(df, keys).select(*keys, part(text).cast("string").alias("text")), *keys, text="text")


def _head(df, keys, args):
    o, rest = options(args, "", "nc", "head", "n")
    _none(rest, "head")
    if "c" in o:
        n = int(o["c"][0])
        return _bytes(df, keys, lambda t: F.substring(t, 1, n) if n >= 0 else F.substr(t, F.lit(1), F.greatest(F.octet_length(t) + n, F.lit(0))))
    n = int((o.get("n") or ["10"])[0])
    if n < 0:  # all but the last
        w = Window.partitionBy(*keys).orderBy(F.desc("ln"))
        return _renumber(df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > -n).drop("_r"), keys, F.col("ln"))
    return _renumber(df, keys, F.col("ln")).where(F.col("ln") <= n)


def _tail(df, keys, args):
    o, rest = options(args, "", "nc", "tail", "n")
    _none(rest, "tail")
    if "c" in o:
        spec = o["c"][0]
        n = int(spec.lstrip("+-"))
        return _bytes(df, keys, lambda t: F.substr(t, F.lit(max(n, 1))) if spec.startswith("+") else F.substr(t, F.greatest(F.octet_length(t) - n + 1, F.lit(1))))
    spec = (o.get("n") or ["10"])[0]
    n = int(spec.lstrip("+-"))
    if spec.startswith("+"):
        return _renumber(_renumber(df, keys, F.col("ln")).where(F.col("ln") >= n), keys, F.col("ln"))
    last = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ln")))).where(F.col("_r") <= n).drop("_r")
    return _renumber(last, keys, F.col("ln"))


def _sed(df, keys, args):
    o, rest = options(args, "nEr", "e", "sed")
    scripts = o.get("e") or rest[:1]
    _none(rest, "sed", 0 if "e" in o else 1)
    if not scripts:
        raise ValueError("sed: a script is missing")
    return _unwhole(sed(_whole(df, keys), "\n".join(scripts), keys, "n" in o, not ("E" in o or "r" in o)), keys)


def _cat(df, keys, args):
    o, rest = options(args, "nbsETvAet", "", "cat")
    _none([x for x in rest if x != "-"], "cat")
    line = F.col("line")
    if "s" in o:
        empty = (line == "") & F.coalesce(F.lag("line").over(Window.partitionBy(*keys).orderBy("ln")) == "", F.lit(False))
        df = _renumber(df.withColumn("_e", empty).where("not _e").drop("_e"), keys, F.col("ln"))
    if "v" in o or "A" in o or "e" in o or "t" in o:  # control characters but tab, as ^ and a letter
        line = F.array_join(F.transform(F.split(line, ""), lambda c: F.when((F.ascii(c) < 32) & (F.ascii(c) != 9) & (c != ""), F.concat(F.lit("^"), F.chr(F.ascii(c) + 64))).when(F.ascii(c) == 127, "^?").otherwise(c)), "")
    if "T" in o or "A" in o or "t" in o:
        line = F.replace(line, F.lit("\t"), F.lit("^I"))
    if "E" in o or "A" in o or "e" in o:
        line = F.concat(line, F.lit("$"))
    if "b" in o:
        full = F.row_number().over(Window.partitionBy(*keys, F.col("line") == "").orderBy("ln"))
        line = F.when(F.col("line") == "", line).otherwise(F.format_string("%6d\t%s", full, line))
    elif "n" in o:
        line = F.format_string("%6d\t%s", F.row_number().over(Window.partitionBy(*keys).orderBy("ln")), line)
    return df.withColumn("line", line)


def _wc(df, keys, args):
    o, rest = options(args, "lwmc", "", "wc")
    _none(rest, "wc")
    words = F.regexp_count("line", F.lit(r"\S+"))
    each = {"l": F.count("*"), "w": F.sum(words), "m": F.sum(F.char_length("line") + 1), "c": F.sum(F.octet_length("line") + 1)}
    chosen = [each[k] for k in "lwmc" if k in o] or [each["l"], each["w"], each["c"]]
    return df.groupBy(*keys).agg(F.concat_ws(" ", *(c.cast("string") for c in chosen)).alias("line")).select(*keys, F.lit(1).cast("long").alias("ln"), "line")


def _nl(df, keys, args):
    o, rest = options(args, "", "vwsbi", "nl")
    _none(rest, "nl")
    start, step, width, sep, body = int((o.get("v") or ["1"])[0]), int((o.get("i") or ["1"])[0]), int((o.get("w") or ["6"])[0]), (o.get("s") or ["\t"])[0], (o.get("b") or ["t"])[0]
    if body not in ("a", "t", "n"):
        raise ValueError(f"nl: unknown style {body!r}")
    counted = {"a": F.lit(True), "t": F.col("line") != "", "n": F.lit(False)}[body]
    number = (F.row_number().over(Window.partitionBy(*keys, counted).orderBy("ln")) - 1) * step + start
    bare = F.concat(F.lit(" " * (width + len(sep))), "line")
    return df.withColumn("line", F.when(counted, F.concat(F.lpad(number.cast("string"), width, " ") if width else number.cast("string"), F.lit(sep), "line")).otherwise(bare))


def _find(df, keys, args):
    """The files, as lines of one stream: tests -name -iname -path -size -empty -type f, ! -not -a -o and parentheses; -maxdepth and -mindepth."""
    files = df.groupBy(*keys).agg(F.sum(F.octet_length("line") + 1).alias("_size")).withColumn("_path", _path(keys))
    base, words, at = F.element_at(F.split("_path", "/"), -1), list(args), 0
    while words and not words[0].startswith("-") and words[0] not in ("!", "("):
        root = words.pop(0).rstrip("/").removeprefix("./")
        if root not in (".", ""):
            files = files.where((F.col("_path") == root) | F.col("_path").startswith(root + "/"))

    def value(name: str) -> str:
        nonlocal at
        if at >= len(words):
            raise ValueError(f"find: {name} needs a value")
        at += 1
        return words[at - 1]

    def test() -> Column:
        nonlocal at
        if at >= len(words):
            raise ValueError("find: a test is missing")
        word = words[at]
        at += 1
        if word in ("!", "-not"):
            return ~test()
        if word == "(":
            inside = either()
            if at >= len(words) or words[at] != ")":
                raise ValueError("find: ) is missing")
            at += 1
            return inside
        if word in ("-name", "-iname"):
            return (F.lower(base) if word == "-iname" else base).rlike(glob_pattern(value(word).lower() if word == "-iname" else value(word)))
        if word == "-path":
            return F.concat(F.lit("./"), "_path").rlike(glob_pattern(value(word)))
        if word == "-type":
            return F.lit(value(word) == "f")
        if word == "-empty":
            return F.col("_size") <= 1
        if word in ("-maxdepth", "-mindepth"):
            depth, n = F.size(F.split("_path", "/")), int(value(word))
            return depth <= n if word == "-maxdepth" else depth >= n
        if word == "-size":
            spec = value(word)
            sign, unit = spec[:1] if spec[:1] in "+-" else "", {"c": 1, "k": 1024, "M": 1 << 20, "G": 1 << 30}.get(spec[-1], 512)
            n = F.ceil(F.col("_size") / unit)
            want = int(spec.strip("+-ckMGb"))
            return n > want if sign == "+" else n < want if sign == "-" else n == want
        if word == "-print":
            return F.lit(True)
        raise ValueError(f"find: unknown test {word!r}")

    def both() -> Column:
        nonlocal at
        out = test()
        while at < len(words) and words[at] not in ("-o", "-or", ")"):
            if words[at] in ("-a", "-and"):
                at += 1
            out = out & test()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(words) and words[at] in ("-o", "-or"):
            at += 1
            out = out | both()
        return out

    if words:
        files = files.where(either())
        _none(words[at:], "find")
    # one stream: all keys null, in order of the paths
    out = files.select(F.concat(F.lit("./"), "_path").alias("line"))
    w = Window.partitionBy(F.lit(0)).orderBy("line")  # the list of names alone
    return out.select(*(F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys), F.row_number().over(w).cast("long").alias("ln"), "line")


def _stream(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Lines of several files as one stream: file after file, by the order of their keys."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(*keys)) - F.col("_n"))  # a row a file
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("ln"))
    out = df.withColumn("_own", own).join(before, list(keys)).withColumn("ln", (F.col("_before") + F.col("_own")).cast("long"))
    return out.select(*(F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys), "ln", "line")


def _xargs(files, names, keys, args):
    """The command on the files that the lines name; lines that name none are passed over."""
    at = 0
    while at < len(args) and args[at].startswith("-"):
        at += 2 if args[at] in ("-n", "-P", "-L") else 1
    options(args[:at], "r0", "nPL", "xargs")  # sizes of batches do not change what is found
    command = args[at:]
    wanted = names.select(F.regexp_replace("line", r"^\./", "").alias("_name")).distinct()
    chosen = files.withColumn("_name", _path(keys)).join(wanted, "_name", "left_semi").drop("_name")
    name, *more = command or ["echo"]
    if name == "echo":
        return names
    if name in ("grep", "egrep", "fgrep", "rg"):
        more = {"egrep": ["-E"], "fgrep": ["-F"]}.get(name, []) + more
        return _stream((_rg if name == "rg" else _grep)(chosen, keys, more, several=True), keys)
    if name == "cat":
        return _cat(_stream(chosen, keys), keys, more)
    if name not in STAGES or name in ("find", "xargs"):
        raise ValueError(f"xargs: unknown command {name!r}")
    return _stream(STAGES[name](chosen, keys, more), keys)


def _awk(df, keys, args):
    o, rest = options(args, "", "Fv", "awk")
    if len(rest) != 1:
        raise ValueError("awk: one program")
    variables = dict(v.split("=", 1) for v in o.get("v") or [])
    if "F" in o:
        variables["FS"] = "\t" if o["F"][0] == "t" else o["F"][0]
    files = df.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
    return lines(awk(files, rest[0], "text", keys, **variables), *keys, text="out")


def _diff(df, keys, args):
    raise ValueError("diff takes two inputs: use weft.operators.version")


def _bare(name: str, change: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> Stage:
    """A command that takes no options."""

    def stage(df, keys, args):
        _none(args, name)
        return change(df, keys)

    return stage


STAGES: dict[str, Stage] = {
    "awk": _awk,
    "mawk": _awk,
    "diff": _diff,
    "grep": _grep,
    "rg": _rg,
    "find": _find,
    "egrep": lambda df, keys, args: _grep(df, keys, ["-E", *args]),
    "fgrep": lambda df, keys, args: _grep(df, keys, ["-F", *args]),
    "sort": _sort,
    "uniq": _uniq,
    "cut": _cut,
    "tr": _tr,
    "head": _head,
    "tail": _tail,
    "sed": _sed,
    "wc": _wc,
    "nl": _nl,
    "rev": _bare("rev", lambda df, keys: df.withColumn("line", F.reverse("line"))),
    "cat": _cat,
    "tac": _bare("tac", lambda df, keys: _renumber(df, keys, F.desc("ln"))),
    "true": _bare("true", lambda df, keys: df.where(F.lit(False))),
    "false": _bare("false", lambda df, keys: df.where(F.lit(False))),
    "sha256sum": _bare("sha256sum", lambda df, keys: df.groupBy(*keys).agg(F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).cast("binary"), 256).alias("line")).select(*keys, F.lit(1).cast("long").alias("ln"), "line")),
    "base64": _bare("base64", lambda df, keys: df.withColumn("line", F.replace(F.base64(F.col("line").cast("binary")), F.lit("\r\n"), F.lit("")))),
}


#: Commands whose status says whether they found anything.
FINDS = {"grep", "egrep", "fgrep", "rg"}


def _pipeline(df: DataFrame, stages: list[list[str]], keys: tuple[str, ...]) -> DataFrame:
    files = df
    for name, *args in stages:
        if name == "xargs":
            df = _xargs(files, df, keys, args)
        elif (stage := STAGES.get(name)) is not None:
            df = stage(df, keys, args)
        elif name in COMMANDS:
            df = COMMANDS[name](df, *args)
        else:
            known = closest(name, [*STAGES, *COMMANDS, "xargs"])
            raise ValueError(f"unknown command {name!r}" + (f"; did you mean {known!r}?" if known else ""))
    return df.select(*keys, "ln", "line")


def run(df: DataFrame, line: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The lines (keys, ln, line) that pipelines of commands make of the lines of df.

    Every pipeline reads df; what follows another one's output comes after it in
    each file. && and || look at whether a search at a pipeline's end found
    anything (any other command but false succeeds), which runs that search.
    """
    parts: list[DataFrame] = []
    fine = True
    for joint, stages in parse_list(line):
        if joint == "&&" and not fine or joint == "||" and fine:
            continue
        out = _pipeline(df, stages, keys)
        last = stages[-1][0]
        quiet = last in FINDS and any(a.startswith("-") and not a.startswith("--") and "q" in a for a in stages[-1][1:])
        if joint or len(parse_list(line)) > 1:
            seen = _pipeline(df, [*stages[:-1], [last, *(a.replace("q", "") if a.startswith("-") else a for a in stages[-1][1:] if a != "-q")]], keys) if quiet else out
            fine = last != "false" and not (last in FINDS and seen.isEmpty())
        parts.append(out)
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return df.where(F.lit(False)).select(*keys, "ln", "line")
    every = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return _renumber(every, keys, F.col("_part"), F.col("ln")).drop("_part")
