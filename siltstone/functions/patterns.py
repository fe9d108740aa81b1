"""Compilers from small query texts to columns; they run on the driver and leave no Python in the plan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.columns import col, path_base, path_prefixes, quoted


def glob_to_regex(glob: str) -> str:
    """`*` and `?` stay inside a segment, `**` crosses; anchored at both ends."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], quoted(glob[i])), i + 1
    return f"^{out}$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def search_condition(text, pattern: str, regex: bool = False, case: bool = False, word: bool = False) -> Column:
    """Literal and regardless of case unless said otherwise; word: whole words."""
    body = pattern if regex else quoted(pattern)
    body = rf"\b(?:{body})\b" if word else body
    if not regex and not word:
        return col(text).contains(pattern) if case else F.lower(col(text)).contains(pattern.lower())
    return col(text).rlike(body if case else f"(?i){body}")


def refine_condition(expr: str, path="path", text="text") -> Column:
    """`|` parts groups of which one must hold; blanks join terms that all must; -x denies; file: and path: look at names."""
    base, whole, both = F.lower(path_base(path)), F.lower(col(path)), F.lower(F.concat_ws(" ", col(path), col(text)))
    groups = []
    for group in expr.split("|"):
        terms = []
        for term in group.split():
            deny, term = term.startswith("-") and len(term) > 1, term.removeprefix("-") if len(term) > 1 else term
            kind, _, rest = term.partition(":")
            where, needle = (base, rest) if kind.lower() == "file" and rest else (whole, rest) if kind.lower() == "path" and rest else (both, term)
            hit = where.contains(needle.lower())
            terms.append(~hit if deny else hit)
        if terms:
            groups.append(all_of(terms))
    return any_of(groups) if groups else F.lit(True)


def refine_refs_condition(expr: str, path="path", text="text", func=None) -> Column:
    """Terms that all must hold, -x denying; file: and path: look at the path, others at path, text and function."""
    names, parts = F.lower(col(path)), [col(path), col(text)] + ([col(func)] if func is not None else [])
    every, terms = F.lower(F.concat_ws(" ", *parts)), []
    for term in expr.split():
        deny, term = term.startswith("-") and len(term) > 1, term.removeprefix("-") if len(term) > 1 else term
        kind, _, rest = term.partition(":")
        hit = names.contains(rest.lower()) if kind.lower() in ("path", "file") and rest else every.contains(term.lower())
        terms.append(~hit if deny else hit)
    return all_of(terms)


def path_condition(expr: str, path="path") -> Column:
    """Per term alternatives a|b: a glob (on the base name unless it has a slash), .ext, or a part of the path; -term denies."""
    base, whole, terms = F.lower(path_base(path)), F.lower(col(path)), []
    for term in expr.split():
        deny, term = term.startswith("-") and len(term) > 1, term.removeprefix("-") if len(term) > 1 else term
        hits = []
        for part in filter(None, term.lower().split("|")):
            if "*" in part or "?" in part:
                hits.append((whole if "/" in part else base).rlike(glob_to_regex(part)))
            else:
                hits.append(base.endswith(part) if part.startswith(".") else whole.contains(part))
        terms.append(~any_of(hits) if deny else any_of(hits))
    return all_of(terms)


def include_condition(globs: str, path="path") -> Column:
    """Whether the base name matches one of the globs (commas or blanks between); none given: all match."""
    names = [g.rsplit("/", 1)[-1] for g in globs.replace(",", " ").split()]
    return any_of([path_base(path).rlike(glob_to_regex(g)) for g in names]) if names else F.lit(True)


def name_condition(query: str, name="name", path="path") -> Column:
    """Blank-separated parts stand in the name in this order; path: and file: terms restrict the path."""
    words, paths = [], []
    for term in query.split():
        kind, _, rest = term.partition(":")
        (paths if kind in ("path", "file") and rest else words).append(rest if kind in ("path", "file") and rest else term)
    by_name = col(name).rlike("(?i)" + ".*".join(map(quoted, words))) if words else F.lit(True)
    return by_name & all_of([path_condition(p, path) for p in paths])


def segment_regex(glob: str) -> str | None:
    """A pattern for one segment: `*`, `?`, classes `[a-z]` and `[^a-z]`, and `\\` before a literal; None where it can't be read, which matches nothing."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out += quoted(glob[i])
        elif c == "[":
            found = re.match(r"\[(\^?)((?:\\.|[^\\\]])+)\]", glob[i:])
            if not found:
                return None
            body = re.sub(r"\\(.)|(.)", lambda m: "-" if m[2] == "-" else "\\" + (m[1] or m[2]) if not (m[1] or m[2]).isalnum() else m[1] or m[2], found[2])
            out += f"(?!/)[{found[1]}{body}]"
            i += len(found[0]) - 1
        else:
            out += quoted(c)
        i += 1
    return out


def ignore_regex(pattern: str, rooted: bool) -> str | None:
    """A path pattern of gitignore: `**` is any number of segments where it is one by itself; without a slash it fits the last segment at any depth."""
    segments = pattern.split("/")
    parts = [None if s == "**" else segment_regex(s) for s in segments]
    if any(p is None and s != "**" for p, s in zip(parts, segments, strict=True)):
        return None
    if not rooted:
        return f"^(?:.*/)?{parts[0] if parts[0] is not None else '[^/]*'}$"
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part is None:
            out += ".+" if last else "(?:[^/]+/)*"
        else:
            out += part + ("" if last else "/")
    return f"^{out}$"


def exclusion_rules(text: str) -> list[tuple[str, bool, bool]]:
    """(pattern, negated, folders only) of gitignore lines."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated or line.startswith("\\") else line
        folders, line = line.endswith("/"), line.removesuffix("/")
        rooted, line = line.startswith("/"), line.removeprefix("/")
        if line and (pattern := ignore_regex(line, rooted or "/" in line)):
            rules.append((pattern, negated, folders))
    return rules


def excluded(path, text: str) -> Column:
    """Whether gitignore rules exclude a file: the last rule that fits a path decides on it, and a folder that is out takes all below it along."""
    rules, whole = exclusion_rules(text), col(path)

    def out(prefix):
        verdict = F.lit(False)
        for pattern, negated, folders in rules:  # later rules wrap earlier ones
            hit = prefix.rlike(pattern) & (prefix != whole) if folders else prefix.rlike(pattern)
            verdict = F.when(hit, F.lit(not negated)).otherwise(verdict)
        return verdict

    return F.exists(path_prefixes(whole), out) if rules else F.lit(False)


def zero_hit_looks_like_regex(pattern: str) -> bool:
    return any(m in pattern for m in ("\\b", "\\w", "\\s", "\\d", ".*", ".+", "[", "(?", "|", "^", "$"))


def parse_defines(expr) -> Column:
    """`A=1 B C=x` as a map: a bare name and a bad value are 1."""
    items = F.filter(F.split(F.trim(col(expr)), r"[\s,;]+"), lambda s: s != "")
    value = lambda s: F.coalesce(F.when(s.contains("="), F.substring_index(s, "=", -1).try_cast("int")), F.lit(1))
    return F.map_from_entries(F.transform(items, lambda s: F.struct(F.substring_index(s, "=", 1), value(s))))
