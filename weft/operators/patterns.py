"""Pattern translation on the driver: globs and basic regular expressions to Java patterns."""

from __future__ import annotations

import re

#: POSIX bracket classes and what Java calls them.
POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "blank": r" \t", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}"}
META = set("\\^$.|?*+()[]{}")


def quote(literal: str) -> str:
    """A Java pattern for the literal."""
    return "".join("\\" + c if c in META else c for c in literal)


def is_literal(pattern: str) -> bool:
    """Whether a pattern has no operator, so that containment can replace matching."""
    return not set(pattern) & META


def glob_pattern(glob: str, cross: bool = True) -> str:
    """An anchored Java pattern of a glob; with cross, * and ? also match slashes; ** always does."""
    any_, one, out, i = (".*", ".", "", 0) if cross else ("[^/]*", "[^/]", "", 0)
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out += ".*"
            i += 1
        elif c == "*":
            out += any_
        elif c == "?":
            out += one
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += quote(c)
        i += 1
    return f"^(?s:{out})$"


def glob_prefix(glob: str) -> str:
    """What every match starts with: a filter that Parquet can use."""
    return re.split(r"[*?\[]", glob, maxsplit=1)[0]


def _brackets(body: str) -> str:
    return re.sub(r"\[:(\w+):\]", lambda m: POSIX.get(m[1], m[0]), body).replace("[", r"\[") if "[:" not in body else re.sub(r"\[:(\w+):\]", lambda m: POSIX.get(m[1], m[0]), body)


def java_pattern(pattern: str, basic: bool = False) -> str:
    """A Java pattern of a POSIX one. In basic syntax ( ) { } | + ? are operators only after a backslash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if basic and nxt in "(){}|+?":
                out += nxt
            elif nxt == "<" or nxt == ">":
                out += r"\b"
            else:
                out += c + nxt
            i += 2
            continue
        if c == "[":
            end = i + 1
            end += pattern[end : end + 1] == "^"
            end += pattern[end : end + 1] == "]"
            while end < len(pattern) and pattern[end] != "]":
                end = pattern.index(":]", end) + 2 if pattern.startswith("[:", end) else end + 1
            out += "[" + _brackets(pattern[i + 1 : end]) + "]"
            i = end + 1
            continue
        if basic and c in "(){}|+?":
            out += "\\" + c
        elif basic and c == "*" and not out:
            out += r"\*"
        else:
            out += c
        i += 1
    return out


def search_pattern(patterns: list[str], *, fixed: bool = False, basic: bool = True, word: bool = False, whole: bool = False, ignore_case: bool = False) -> str:
    """One Java pattern for the alternatives of a search and its options."""
    parts = [quote(p) if fixed else java_pattern(p, basic) for p in patterns]
    one = "|".join(f"(?:{p})" for p in parts)
    if whole:
        one = f"^(?:{one})$"
    elif word:
        one = rf"(?<!\w)(?:{one})(?!\w)"
    return ("(?i)" if ignore_case else "") + one
