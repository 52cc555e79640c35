"""Scalar functions that Spark lacks, as compositions of its own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(c: Column) -> Column:
    """Lower case; runs outside [a-z0-9] become one hyphen; no hyphen at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def heading_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[ -]", "-"), r"[^\p{L}\p{Nd}_-]", "")


def field_name_of_heading(c: Column) -> Column:
    """Letters and digits in lower case, other runs as one underscore; "section" if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a glob whose * and ? stop at a slash; None for a malformed one."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif ch == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            out.append("[" + "^" * negated + re.sub(r"([\[&^])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def glob_match(c: Column, pattern: str, *, malformed: bool = False) -> Column:
    regex = glob_regex(pattern)
    return F.lit(malformed) if regex is None else c.rlike(regex)


def any_component(path: Column, patterns: list[str]) -> Column:
    """Whether any component of a path matches any of the globs."""
    regexes = [r for p in patterns if (r := glob_regex(p))]
    return F.exists(F.split(path, "/"), lambda x: F.coalesce(*[x.rlike("|".join(regexes))])) if regexes else F.lit(False)


def close_enough(a: Column, b: Column) -> Column:
    """Case-insensitive edit distance within max(2, a third of the length)."""
    return F.levenshtein(F.lower(a), F.lower(b)) <= F.greatest(F.lit(2), F.floor(F.length(a) / 3))


def edit_distance(a: str, b: str) -> int:
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def closest(word: str, among) -> str | None:
    """The nearest of the words within max(2, a third of the length); ties go to the first in order."""
    best = min(((edit_distance(word, w), w) for w in among), default=None)
    return best[1] if best and best[0] <= max(2, len(word) // 3) else None


def bold_fields(body: Column) -> Column:
    """map of "**Key**: value" lines: lower-cased key to value, the last one winning."""
    pattern = r"(?m)^[ \t]*(?:[-*][ \t]+)?\*\*([^*\n]+?):?\*\*:?[ \t]*([^\n]*)$"
    keys = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda k: F.lower(F.trim(k)))
    vals = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(2)), lambda v: F.trim(v))
    pairs = F.arrays_zip(keys.alias("k"), vals.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def next_in_sequence(names: Column, prefix: str, digits: int) -> Column:
    """Aggregate: the largest number after the prefix, plus one, zero-padded, with the prefix."""
    n = F.coalesce(F.max(F.regexp_extract(names, "^" + re.escape(prefix) + "([0-9]+)", 1).try_cast("bigint")), F.lit(0)) + 1
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= digits, s).otherwise(F.lpad(s, digits, "0")))
