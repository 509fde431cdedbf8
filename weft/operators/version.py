"""Version analytics: object ids, tree building, change sets, renames, three-way merges and line diffs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .lineage import cut
from .patterns import glob_pattern
from .relational import three_way


def blob_id(content: Column) -> Column:
    """SHA-1 of the type, the size in bytes, a zero byte and the content."""
    return F.sha1(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\x00"), content).cast("binary"))


def build_trees(files: DataFrame) -> DataFrame:
    """(dir, tree) of every directory, the root as '': each level is hashed from the one below it.

    files: path, content. An entry is its mode, a blank, its name, a zero byte and
    the twenty bytes of its id; entries stand in byte order of their names, a
    directory's with a slash at its end; a tree's id is the SHA-1 of the type, the
    size in bytes, a zero byte and the entries.
    """
    split = F.split("path", "/")
    level = files.select(F.array_join(F.slice(split, F.lit(1), F.size(split) - 1), "/").alias("dir"), F.element_at(split, -1).alias("name"), F.lit("100644").alias("mode"), blob_id(F.col("content")).alias("oid"))
    depth = files.agg(F.max(F.size(split)) - 1).first()[0] or 0
    out = None
    for d in range(depth, -1, -1):
        at = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
        name = F.when(F.col("mode") == "40000", F.concat("name", F.lit("/"))).otherwise(F.col("name")).cast("binary")
        entry = F.concat(F.hex(F.concat_ws(" ", "mode", "name").cast("binary")), F.lit("00"), "oid")
        made = level.where(at == d).groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name.alias("name"), entry.alias("e")))), lambda x: x["e"]), "").alias("body"))
        head = F.concat(F.hex(F.concat(F.lit("tree "), (F.length("body") / 2).cast("long").cast("string")).cast("binary")), F.lit("00"))
        # each level is read by the one above it and by the result
        trees = cut(made.select("dir", F.sha1(F.unhex(F.concat(head, "body"))).alias("tree")))
        out = trees if out is None else out.unionByName(trees)
        up = F.split("dir", "/")
        level = level.where(at < d).unionByName(trees.where("dir <> ''").select(F.array_join(F.slice(up, F.lit(1), F.size(up) - 1), "/").alias("dir"), F.element_at(up, -1).alias("name"), F.lit("40000").alias("mode"), F.col("tree").alias("oid")))
    return out


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches the path, or a directory above it, ignores it; ! takes a match back."""
    out = F.lit(False)
    for rule in rules:
        negated = rule.startswith("!")
        body = rule[1:] if negated else rule
        only_dir = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        core = glob_pattern(body, cross=False)[5:-2]
        lead = "^" if anchored else "^(?:.*/)?"
        tail = "/.*$" if only_dir else "(?:/.*)?$"
        out = F.when(path.rlike(lead + core + tail), F.lit(not negated)).otherwise(out)
    return out


def change_set(before: DataFrame, after: DataFrame, key: str = "path", value: str = "oid", mode: str | None = None) -> DataFrame:
    """A, D, M or T (a change of mode alone) for each key that differs."""
    cols = [value] + ([mode] if mode else [])
    b = before.select(key, F.struct(*cols).alias("b"))
    a = after.select(key, F.struct(*cols).alias("a"))
    status = F.when(F.col("b").isNull(), "A").when(F.col("a").isNull(), "D").when(F.col(f"a.{value}") != F.col(f"b.{value}"), "M").otherwise("T")
    return b.join(a, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(key, status.alias("status"))


def status_codes(head: DataFrame, index: DataFrame, worktree: DataFrame, key: str = "path", value: str = "oid") -> DataFrame:
    """Two-letter status of each path that is not clean: index against head, worktree against index; ?? is untracked."""
    met = three_way(head.select(key, value), index.select(key, value), worktree.select(key, value), key)
    h, i, w = (F.col(f"{s}_{value}") for s in ("base", "current", "incoming"))
    staged = F.when(h.isNull() & i.isNotNull(), "A").when(h.isNotNull() & i.isNull(), "D").when(h != i, "M").otherwise(" ")
    work = F.when(i.isNotNull() & w.isNull(), "D").when(i != w, "M").otherwise(" ")
    code = F.when(h.isNull() & i.isNull(), "??").otherwise(F.concat(staged, work))
    return met.select(key, code.alias("code")).where("code <> '  '")


def unmerged_code(base: Column, current: Column, incoming: Column) -> Column:
    """Code of a conflicted path by which of the stages 1, 2 and 3 exist."""
    b, c, i = base.isNotNull(), current.isNotNull(), incoming.isNotNull()
    return F.when(b & ~c & ~i, "DD").when(~b & c & ~i, "AU").when(b & c & ~i, "UD").when(~b & ~c & i, "UA").when(b & ~c & i, "DU").when(~b & c & i, "AA").when(b & c & i, "UU")


def pair_renames(deletes: DataFrame, adds: DataFrame) -> DataFrame:
    """source and destination of exact renames: within an id, equal base names first, the rest in path order.

    Numbering both sides of an id replaces pairing all of them; a delete or add
    is used once.
    """
    base = F.substring_index("path", "/", -1)

    def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
        return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("path"))).select(*by, "n", F.col("path").alias(name))

    d, a = (x.select("path", "oid", base.alias("base")) for x in (deletes, adds))
    same = numbered(d, ["oid", "base"], "source").join(numbered(a, ["oid", "base"], "destination"), ["oid", "base", "n"]).select("oid", "source", "destination")
    left = d.join(same.select(F.col("source").alias("path")), "path", "left_anti")
    right = a.join(same.select(F.col("destination").alias("path")), "path", "left_anti")
    rest = numbered(left, ["oid"], "source").join(numbered(right, ["oid"], "destination"), ["oid", "n"]).select("oid", "source", "destination")
    return same.unionByName(rest)


def resolve(base: Column, current: Column, incoming: Column) -> tuple[Column, Column]:
    """(value, conflict) of one dimension merged three ways."""
    clean = F.when(current.eqNullSafe(incoming), current).when(base.eqNullSafe(current), incoming).when(base.eqNullSafe(incoming), current)
    conflict = ~(current.eqNullSafe(incoming) | base.eqNullSafe(current) | base.eqNullSafe(incoming))
    return clean, conflict


def classify(base: Column, current: Column, incoming: Column) -> Column:
    """clean, content, or the kind of structural conflict of a path on three sides."""
    _, conflict = resolve(base, current, incoming)
    return F.when(~conflict, "clean").when(base.isNull(), "add/add").when(current.isNull() | incoming.isNull(), "modify/delete").otherwise("content")


def edit_script(old: list[str], new: list[str]) -> list[tuple[str, int, int, int, int]]:
    """A shortest script of deletions and insertions: (kind, old start, old end, new start, new end) for =, - and +.

    Greedy search over diagonals (the O(ND) method): for each number of edits
    the farthest place on every diagonal is kept, then traced back.
    """
    n, m = len(old), len(new)
    front = {1: 0}
    trace = []
    for edits in range(n + m + 1):
        trace.append(dict(front))
        for k in range(-edits, edits + 1, 2):
            x = front[k + 1] if k == -edits or (k != edits and front[k - 1] < front[k + 1]) else front[k - 1] + 1
            y = x - k
            while x < n and y < m and old[x] == new[y]:
                x, y = x + 1, y + 1
            front[k] = x
            if x >= n and y >= m:
                return _backtrack(trace, n, m)
    return []


def _backtrack(trace: list[dict[int, int]], x: int, y: int) -> list[tuple[str, int, int, int, int]]:
    steps = []
    for edits in range(len(trace) - 1, -1, -1):
        front = trace[edits]
        k = x - y
        before = k + 1 if k == -edits or (k != edits and front[k - 1] < front[k + 1]) else k - 1
        px = front[before] if edits else 0
        py = px - before if edits else 0
        while x > px and y > py and x > 0 and y > 0:
            steps.append(("=", x - 1, x, y - 1, y))
            x, y = x - 1, y - 1
        if edits:
            steps.append(("+", x, x, y - 1, y) if x == px else ("-", x - 1, x, y, y))
            x, y = px, py
    out: list[list] = []
    for kind, a, b, c, d in reversed(steps):
        if out and out[-1][0] == kind:
            out[-1][2], out[-1][4] = b, d
        else:
            out.append([kind, a, b, c, d])
    return [tuple(s) for s in out]


def unified(old: list[str], new: list[str], around: int = 3) -> str:
    """Unified hunks; hunks whose contexts touch are one."""
    script = edit_script(old, new)
    changes = [s for s in script if s[0] != "="]
    groups: list[list] = []
    for c in changes:
        if groups and c[1] - groups[-1][-1][2] <= 2 * around:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []
    for g in groups:
        a, b = max(0, g[0][1] - around), min(len(old), g[-1][2] + around)
        c, d = max(0, g[0][3] - around), min(len(new), g[-1][4] + around)
        at = lambda s, n: f"{s + (n > 0)}" + (f",{n}" if n != 1 else "")
        out.append(f"@@ -{at(a, b - a)} +{at(c, d - c)} @@")
        x = a
        for kind, p, q, r, s in g:
            out += [" " + line for line in old[x:p]]
            out += ["-" + line for line in old[p:q]] if kind == "-" else ["+" + line for line in new[r:s]]
            x = q
        out += [" " + line for line in old[x:b]]
    return "\n".join(out)


def apply_patch(text: list[str], hunks: str, fuzz: int = 2) -> tuple[list[str], int]:
    """(text, rejected hunks): each hunk at its place or the nearest one that fits, with up to `fuzz` context lines given up at either end."""
    out, shift, rejected = list(text), 0, 0
    blocks = [b for b in ("\n" + hunks).split("\n@@ ")[1:]]
    for block in blocks:
        head, *body = block.split("\n")
        start = int(head.split()[0][1:].split(",")[0])
        start = max(0, start - (0 if ",0" in head.split()[0] else 1)) + shift
        done = False
        for drop in range(fuzz + 1):
            lines_ = list(body)
            lead = trail = 0
            while lead < drop and lines_ and lines_[0].startswith(" "):
                lines_, lead = lines_[1:], lead + 1
            while trail < drop and lines_ and lines_[-1].startswith(" "):
                lines_, trail = lines_[:-1], trail + 1
            want = [x[1:] for x in lines_ if x[:1] in (" ", "-")]
            put = [x[1:] for x in lines_ if x[:1] in (" ", "+")]
            for off in sorted(range(-len(out), len(out) + 1), key=abs):
                at = start + lead + off
                if 0 <= at <= len(out) - len(want) and out[at : at + len(want)] == want:
                    out[at : at + len(want)] = put
                    shift += len(put) - len(want) + off
                    done = True
                    break
            if done:
                break
        rejected += not done
    return out, rejected


def merge_texts(base: list[str], ours: list[str], theirs: list[str], names: tuple[str, str] = ("ours", "theirs")) -> tuple[list[str], int]:
    """(merged lines, conflicts): regions that one side alone changed, or both alike, are taken; others are marked."""

    def matched(other: list[str]) -> dict[int, int]:
        out = {}
        for kind, a, b, c, _ in edit_script(base, other):
            if kind == "=":
                out.update(zip(range(a, b), range(c, c + b - a), strict=True))
        return out

    left, right = matched(ours), matched(theirs)
    out, conflicts = [], 0
    i = a = b = 0
    while i <= len(base):
        j = i
        while j < len(base) and not (j in left and j in right):
            j += 1
        x = left[j] if j < len(base) else len(ours)
        y = right[j] if j < len(base) else len(theirs)
        o, p, q = base[i:j], ours[a:x], theirs[b:y]
        if p == q or q == o:
            out += p
        elif p == o:
            out += q
        else:
            out += [f"<<<<<<< {names[0]}", *p, "=======", *q, f">>>>>>> {names[1]}"]
            conflicts += 1
        if j < len(base):
            out.append(base[j])
        i, a, b = j + 1, x + 1, y + 1
    return out, conflicts


def normal_diff(old: list[str], new: list[str]) -> str:
    """The script as a listing of commands: 2,3c2 with < and > lines, a for added, d for deleted; empty for equal texts."""

    def span(a: int, b: int) -> str:
        return f"{a + 1}" if b == a + 1 else f"{a + 1},{b}" if b > a else f"{a}"

    out: list[str] = []
    changes: list[list[int]] = []
    for kind, a, b, c, d in edit_script(old, new):
        if kind == "=":
            continue
        if changes and changes[-1][1] == a and changes[-1][3] == c:
            changes[-1][1], changes[-1][3] = b, d
        else:
            changes.append([a, b, c, d])
    for a, b, c, d in changes:
        out.append(span(a, b) + ("c" if b > a and d > c else "d" if b > a else "a") + span(c, d))
        out += [f"< {line}" for line in old[a:b]]
        out += ["---"] if b > a and d > c else []
        out += [f"> {line}" for line in new[c:d]]
    return "\n".join(out)


def combined_diff(parents: list[list[str]], result: list[str], around: int = 3) -> str:
    """A result against several parents at once: a column of marks for each parent.

    A line of the result has + where a parent lacks it; a lost line stands
    before the place it is missing from, with - for each parent that had it
    there. Hunks in which the result equals one of the parents are left out.
    """
    n = len(parents)
    added = [[False] * n for _ in result]
    lost: list[list[tuple[str, list[bool]]]] = [[] for _ in range(len(result) + 1)]
    for k, parent in enumerate(parents):
        for kind, a, b, c, d in edit_script(parent, result):
            if kind == "+":
                for i in range(c, d):
                    added[i][k] = True
            elif kind == "-":
                here, gone = lost[c], parent[a:b]
                lost[c] = []
                for how, p, q, r, t in edit_script([line for line, _ in here], gone):
                    if how == "+":
                        lost[c] += [(line, [x == k for x in range(n)]) for line in gone[r:t]]
                    else:
                        lost[c] += [(line, [m or (x == k and how == "=") for x, m in enumerate(marks)]) for line, marks in here[p:q]]
    touched = [i for i in range(len(result) + 1) if lost[i] or (i < len(result) and any(added[i]))]
    groups: list[list[int]] = []
    for i in touched:
        if groups and i - groups[-1][-1] <= 2 * around:
            groups[-1].append(i)
        else:
            groups.append([i])

    def before(k: int, at: int) -> int:
        """Lines of parent k that stand before a place of the result (past its end: all of them)."""
        gone = sum(marks[k] for i in range(at) for _, marks in lost[i])
        return sum(not row[k] for row in added[:at]) + gone

    out = []
    for g in groups:
        changed = [any(marks[k] for i in g for _, marks in lost[i]) or any(i < len(result) and added[i][k] for i in g) for k in range(n)]
        if not all(changed):
            continue
        lo, hi = max(0, g[0] - around), min(len(result), g[-1] + 1 + around)
        end = hi + 1 if hi == len(result) else hi
        body = []
        for i in range(lo, end):
            body += ["".join("-" if m else " " for m in marks) + line for line, marks in lost[i]]
            if i < len(result):
                body.append("".join("+" if m else " " for m in added[i]) + result[i])
        bar = "@" * (n + 1)
        sizes = [before(k, end) - before(k, lo) for k in range(n)]
        olds = " ".join(f"-{before(k, lo) + (sizes[k] > 0)},{sizes[k]}" for k in range(n))
        out.append(f"{bar} {olds} +{lo + (hi > lo)},{hi - lo} {bar}")
        out += body
    return "\n".join(out)


def virtual_base(origin: list[str], bases: list[list[str]]) -> list[str]:
    """One base for several: the bases merged in turn over their origin, marks of conflicts kept as text."""
    out = bases[0] if bases else origin
    for other in bases[1:]:
        out, _ = merge_texts(origin, out, other, ("Temporary merge branch 1", "Temporary merge branch 2"))
    return out


def log_line(template: str, columns: dict[str, Column]) -> Column:
    """A log format as a Column: %H %P %B and so on by name, %h the first seven of H, %s the first line of B, %n a line end, %% a percent sign."""
    parts = []
    for literal, name in re.findall(r"([^%]+)|%(a[nte]|c[nte]|[A-Za-z%])", template):
        if literal:
            parts.append(F.lit(literal))
        elif name in ("n", "%"):
            parts.append(F.lit("\n" if name == "n" else "%"))
        elif name == "h" and "H" in columns:
            parts.append(F.substr(columns["H"], F.lit(1), F.lit(7)))
        elif name == "s" and "B" in columns:
            parts.append(F.substring_index(columns["B"], "\n", 1))
        elif name in columns:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
        else:
            raise ValueError(f"%{name} is not known")
    return F.concat(*parts) if parts else F.lit("")


def _struct(**fields) -> StructType:
    """A type without a session: workers import this module."""
    return StructType([StructField(n, t) for n, t in fields.items()])


def _rows(text: str | None) -> list[str]:
    body = (text or "").removesuffix("\n")
    return body.split("\n") if text else []


@F.pandas_udf(_struct(inserted=LongType(), deleted=LongType(), hunks=StringType()))
def diff_texts(old: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Inserted and deleted lines and unified hunks of (old, new) texts."""
    for a, b in old:
        rows = []
        for x, y in zip(a, b, strict=True):
            p, q = _rows(x), _rows(y)
            script = edit_script(p, q)
            rows.append((sum(s[4] - s[3] for s in script if s[0] == "+"), sum(s[2] - s[1] for s in script if s[0] == "-"), unified(p, q)))
        yield pd.DataFrame(rows, columns=["inserted", "deleted", "hunks"])


@F.pandas_udf(_struct(text=StringType(), conflicts=LongType()))
def merge_three(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Merged text and number of conflicts of (base, ours, theirs)."""
    for base, ours, theirs in parts:
        rows = [merge_texts(_rows(b), _rows(o), _rows(t)) for b, o, t in zip(base, ours, theirs, strict=True)]
        yield pd.DataFrame([("\n".join(m), n) for m, n in rows], columns=["text", "conflicts"])


@F.pandas_udf(_struct(text=StringType(), rejected=LongType()))
def patch_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Patched text and rejected hunks of (text, hunks)."""
    for text, hunks in parts:
        rows = [apply_patch(_rows(t), h or "") for t, h in zip(text, hunks, strict=True)]
        yield pd.DataFrame([("\n".join(t), n) for t, n in rows], columns=["text", "rejected"])


@F.pandas_udf(StringType())
def diff_listing(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """normal_diff of (old, new) texts."""
    for old, new in parts:
        yield pd.Series([normal_diff(_rows(a), _rows(b)) for a, b in zip(old, new, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def diff_combined(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """combined_diff of (array of parent texts, result)."""
    for parents, result in parts:
        yield pd.Series([combined_diff([_rows(x) for x in p], _rows(r)) for p, r in zip(parents, result, strict=True)], dtype=object)


@F.pandas_udf(_struct(text=StringType(), conflicts=LongType()))
def merge_over_bases(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Merged text and number of conflicts of (origin, array of bases, ours, theirs): the bases become one virtual base first."""
    for origin, bases, ours, theirs in parts:
        rows = [merge_texts(virtual_base(_rows(o), [_rows(x) for x in b]), _rows(p), _rows(q)) for o, b, p, q in zip(origin, bases, ours, theirs, strict=True)]
        yield pd.DataFrame([("\n".join(m), n) for m, n in rows], columns=["text", "conflicts"])


@F.pandas_udf(DoubleType())
def jaro_similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """jaro of two texts; null if either is null."""
    for left, right in parts:
        yield pd.Series([None if a is None or b is None else jaro(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def jaro(a: str, b: str) -> float:
    """Jaro similarity, 0 to 1: common characters within half the longer length, less half of those out of order."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    common = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                common.append(c)
                break
    m = len(common)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(common, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def closest(name: str, known: list[str]) -> str | None:
    """The known name most like a misspelt one, if it is like it at all."""
    best = max(known, key=lambda k: jaro(name, k), default=None)
    return best if best is not None and jaro(name, best) >= 0.7 else None
