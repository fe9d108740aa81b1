"""Scalar column functions: paths, anchors, literals, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_base(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def path_dir(path) -> Column:
    """The directory part without a final slash; empty at the top."""
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def path_ext(path) -> Column:
    """The lower-case extension with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path_base(path), r"(\.[^.]*)$", 1))


def path_stem(path) -> Column:
    return F.regexp_replace(path_base(path), r"\.[^.]*$", "")


def path_depth(path) -> Column:
    return F.size(F.split(col(path), "/"))


def group_prefix(path, depth) -> Column:
    """The first `depth` segments; a file above that depth stands for itself."""
    parts, depth = F.split(col(path), "/"), F.lit(depth) if isinstance(depth, int) else col(depth)
    return F.when(F.size(parts) - 1 < depth, col(path)).otherwise(F.array_join(F.slice(parts, F.lit(1), depth), "/"))


def path_prefixes(path) -> Column:
    """All leading paths of a path, itself last."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def path_suffixes(path) -> Column:
    """All trailing paths of a path, itself first."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def normalize_path(path) -> Column:
    """Forward slashes, without . and with .. resolved; null where it leaves the root."""
    parts = F.filter(F.split(F.regexp_replace(col(path), r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    out = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).when(acc.isNotNull(), F.concat(acc, F.array(s))))
    return F.array_join(out, "/")


def under(path, folder: str) -> Column:
    """Whether a path lies under a folder, regardless of case; an empty folder holds all."""
    folder = folder.replace("\\", "/").strip("/").lower()
    return F.lower(col(path)).startswith(folder + "/") if folder else F.lit(True)


def common_segments(a, b) -> Column:
    """How many leading segments two paths share."""
    same = F.zip_with(F.split(col(a), "/"), F.split(col(b), "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def hit_id(path, line, column) -> Column:
    """The first 16 hex digits of sha1(path:line:column)."""
    return F.substring(F.sha1(F.concat_ws(":", col(path), col(line).cast("string"), col(column).cast("string"))), 1, 16)


def trimmed(text) -> Column:
    """Without white space at both ends: blanks, tabs and line ends."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def anchor_key(text) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def usable_anchor(key) -> Column:
    """Whether a key holds more than letters, digits and underscores."""
    return col(key).rlike(r"[^\p{L}\p{Nd}_]")


def quoted(text: str) -> str:
    """A literal as a pattern that both Java and RE2 read."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def contains_word(text, word: str) -> Column:
    return col(text).rlike(rf"\b{quoted(word)}\b")


def brace_balance(code) -> Column:
    return F.regexp_count(col(code), F.lit(r"\{")) - F.regexp_count(col(code), F.lit(r"\}"))


def strip_line_comment(line) -> Column:
    return F.regexp_replace(col(line), r"//.*$", "")


def common_indent(lines) -> Column:
    """The least indent of the lines that hold something."""
    full = F.filter(col(lines), lambda s: F.trim(s) != "")
    return F.array_min(F.transform(full, lambda s: F.length(s) - F.length(F.ltrim(s))))


def strip_common_indent(lines) -> Column:
    indent = common_indent(lines)
    return F.transform(col(lines), lambda s: F.substring(s, F.coalesce(indent, F.lit(0)) + 1, F.length(s)))


def split_line_key(key) -> Column:
    """(path, line_no) of `path::line`, split at the last mark."""
    return F.struct(F.regexp_extract(col(key), r"^(.*)::(\d+)$", 1).alias("path"), F.regexp_extract(col(key), r"^(.*)::(\d+)$", 2).try_cast("int").alias("line_no"))


def common_prefix(low, high) -> Column:
    """The common start of the least and the greatest of some names."""
    a, b = col(low), col(high)
    n = F.least(F.length(a), F.length(b))
    fit = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.substring(a, F.lit(1), F.array_max(fit))


def parse_int_literal(text) -> Column:
    """The value of a C integer literal (decimal, 0x, 0b, 0 octal, suffixes u and l); null for anything else."""
    s = F.lower(F.regexp_replace(F.trim(col(text)), r"(?<=[0-9a-fA-F])[uUlL]+$", ""))
    base = lambda start, radix: F.conv(F.substring(s, start, F.length(s)), radix, 10).try_cast("long")
    return F.when(s.rlike(r"^0x[0-9a-f]+$"), base(F.lit(3), 16)).when(s.rlike(r"^0b[01]+$"), base(F.lit(3), 2)).when(s.rlike(r"^0[0-7]+$"), base(F.lit(2), 8)).when(s.rlike(r"^[0-9]+$"), s.try_cast("long"))


def radix_forms(n) -> Column:
    return F.struct(F.lower(F.hex(col(n))).alias("hex"), F.conv(col(n).cast("string"), 10, 8).alias("oct"), F.bin(col(n)).alias("bin"))


def set_bits(n) -> Column:
    """The places of the bits that are set, low first."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("bit_get", col(n).cast("long"), i) == 1)


def nth_arg(args, i: int) -> Column:
    """The i-th of comma-separated arguments, from 0; commas inside brackets don't part them."""
    marks = F.filter(F.split(F.regexp_replace(col(args), r"", "\u0001"), "\u0001"), lambda c: c != "")
    step = lambda acc, c: F.struct(
        (acc["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).alias("depth"),
        F.concat(acc["text"], F.when((c == ",") & (acc["depth"] == 0), F.lit("\u0002")).otherwise(c)).alias("text"),
    )
    parted = F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step)["text"]
    return F.trim(F.get(F.split(parted, "\u0002"), i))
