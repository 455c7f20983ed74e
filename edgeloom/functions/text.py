"""Identifiers, slugs and codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_set(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def slugify(c: Column) -> Column:
    """Lower case; runs of blanks and dashes become `_`; brackets go."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[ -]+", "_"), "[ ()]", "")


def slug_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^-a-z0-9._/]+", "-"), F.lit("-"))


def kebab(c: Column) -> Column:
    """CamelCase to kebab-case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1-$2"), "([a-z0-9])([A-Z])", "$1-$2"))


def id_tag(c: Column, fallback: str = "unknown") -> Column:
    """Lower case with single dots between runs of letters and digits."""
    tag = F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "."), F.lit("."))
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit(fallback))


def underscored(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_code(c: Column) -> Column:
    """Lower case without what stands before the first dot."""
    return F.regexp_replace(F.lower(c), r"^[^.]*\.", "")


def nuts_level(code: Column, level: str) -> Column:
    """A region code cut to `country`, `nuts1`, `nuts2` or `nuts3`."""
    n = F.length(code)
    two = F.left(code, F.lit(2))
    cut = lambda k: F.left(code, n - k)
    return {"nuts3": code, "nuts2": F.when(n >= 3, cut(1)).otherwise(code), "nuts1": F.when(n >= 4, cut(2)).otherwise(two), "country": two}[level]


def selected_region(code: Column, selectors: list[str]) -> Column:
    """Two-letter selectors compare countries, longer ones prefixes; no selector takes all."""
    out = F.lit(not selectors)
    for s in selectors:
        out = out | ((F.left(code, F.lit(2)) == s) if len(s) == 2 else code.startswith(s))
    return out


def glob_pattern(glob: str) -> str:
    """A regular expression for *, ? and [..]."""
    out, k = "", 0
    while k < len(glob):
        c, end = glob[k], glob.find("]", k + 1)
        if c == "[" and end > 0:
            out += "[" + glob[k + 1 : end].replace("!", "^", glob[k + 1 : k + 2] == "!") + "]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        k += 1
    return f"^{out}$"


def technology_matches(tech: Column, pattern: str) -> Column:
    """A glob, or a dotted prefix; case does not count."""
    low, p = F.lower(tech), pattern.lower()
    return low.rlike(glob_pattern(p)) if any(c in p for c in "*?[") else (low == p) | low.startswith(p + ".")


def longest_pattern(tech: Column, groups: dict[str, list[str]], fallback: Column | None = None) -> Column:
    """The group whose matching pattern is longest; of equally long ones the longer group name, then the first."""
    pairs = sorted(((g, p) for g, ps in groups.items() for p in ps), key=lambda x: (-len(x[1]), -len(x[0])))
    out = None
    for g, p in pairs:
        out = F.when(technology_matches(tech, p), g) if out is None else out.when(technology_matches(tech, p), g)
    return (fallback if out is None else out.otherwise(tech if fallback is None else fallback)) if out is not None or fallback is not None else tech


def split_targets(c: Column) -> Column:
    """A JSON list, else parts between `;`, else between `,`; blanks go."""
    by_json = F.from_json(c, "array<string>")
    parts = F.when(F.trim(c).startswith("["), by_json).when(c.contains(";"), F.split(c, ";")).otherwise(F.split(c, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
