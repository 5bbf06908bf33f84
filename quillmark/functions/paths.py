"""Path and name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANG_BY_EXT = {"java": ["java"], "go": ["go"], "ts": ["ts", "tsx", "js", "jsx", "mjs", "cjs"], "kt": ["kt"], "cs": ["cs"], "py": ["py"], "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "h"]}
FENCE_BY_EXT = {"go": ["go"], "java": ["java"], "ts": ["ts", "tsx", "js", "jsx", "mjs", "cjs"], "kotlin": ["kt"], "csharp": ["cs"], "python": ["py"], "markdown": ["md"]}


def extension(path: Column) -> Column:
    """With its dot and in lower case; empty if the last segment has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def lang_of(path: Column) -> Column:
    """Language tag of a path; empty if unknown. All of the script family is ts."""
    return F.coalesce(_lookup(path, LANG_BY_EXT), F.lit(""))


def fence_of(path: Column) -> Column:
    """Tag of a fenced code block."""
    return F.coalesce(_lookup(path, FENCE_BY_EXT), F.lit(""))


def _lookup(path: Column, table: dict[str, list[str]]) -> Column:
    """Null if no tag has the extension, which is found once."""
    tags = [F.lit(x) for tag, exts in table.items() for e in exts for x in (f".{e}", tag)]
    return F.try_element_at(F.create_map(*tags), extension(path))


def qualified(*parts: Column) -> Column:
    """Trimmed non-empty parts, joined by dots."""
    return F.concat_ws(".", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def normal_path(path: Column) -> Column:
    """One leading ``./`` goes, backslashes become slashes, runs of slashes one."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), "/+", "/")


def slug(name: Column) -> Column:
    """Runs of other than letters, digits, ``.``, ``_`` and ``-`` become one dash; outer dashes go; ``anchor`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit("")), F.lit("anchor"))


def symbol_label(symbol: Column) -> Column:
    return F.concat(F.lit("SYM:"), F.substring_index(symbol, ".", -2))


def patch_base(path: Column) -> Column:
    """A flat file name of a path."""
    flat = F.regexp_replace(F.regexp_replace(path, r'[/\\:*?"<>|]', "_"), r"^[._]+", "")
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit("patch"))


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(8))


def folded(path: Column, keep_up: bool) -> Column:
    """Segments without empty ones and ``.``; ``..`` takes one away. Above the root it goes, or stays if ``keep_up``."""
    start = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        above = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) == "..")
        popped = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        up = F.when(above, F.concat(acc, F.array(F.lit("..")))).otherwise(popped) if keep_up else popped
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.split(path, "/", -1), start, step)


def safe_entry(path: Column) -> Column:
    """A name for an archive entry: no drive, no leading slash, no way out of the root; ``entry`` if nothing is left."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^[A-Za-z]:", "")
    return F.coalesce(F.nullif(F.array_join(folded(p, False), "/"), F.lit("")), F.lit("entry"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def java_package(path: Column) -> Column:
    """Dots for the directory; ``default`` at the root."""
    d = F.regexp_replace(parent(path), r"^[/.]+|[/.]+$", "")
    return F.when(d == "", "default").otherwise(F.replace(d, F.lit("/"), F.lit(".")))


def go_package(path: Column) -> Column:
    """The last segment of the directory; ``main`` at the root."""
    d = F.regexp_replace(parent(path), r"^[/.]+|[/.]+$", "")
    return F.when(d == "", "main").otherwise(F.substring_index(d, "/", -1))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def relative_spec(file: Column, spec: Column) -> Column:
    """Node of a relative import of ``file``."""
    joined = F.array_join(folded(F.concat_ws("/", F.nullif(parent(file), F.lit("")), spec), True), "/")
    return F.concat(F.lit("js:"), without_extension(F.when(joined == "", ".").otherwise(joined)))


def receiver_type(receiver: Column) -> Column:
    """Base type in a method's receiver."""
    inner = F.trim(F.regexp_replace(F.regexp_replace(F.trim(receiver), r"^\(", ""), r"\)$", ""))
    last = F.substring_index(F.trim(F.regexp_replace(inner, r"[\t\n\f\r ]+", " ")), " ", -1)
    return F.substring_index(F.substring_index(F.regexp_replace(last, r"^[*&]+", ""), "[", 1), ".", -1)


def jdk_number(version: Column) -> Column:
    """``1.8`` is 8; else the leading digits, of which there may be none."""
    v = F.trim(version)
    return F.when(v.startswith("1.") & (F.length(v) > 2), F.substring(v, 3, 1 << 20)).otherwise(F.regexp_extract(v, r"^([0-9]*)", 1))


#: White space in patterns, as Unicode has it.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def csv_items(text: Column) -> Column:
    """The items of a comma-separated list, without outer white space and empty ones; none of a null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), stripped), lambda x: x != "")


def similarity_lines(text: Column) -> Column:
    """The lines of a text for comparing: runs of white space are one space, outer ones and empty lines go."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: stripped(F.regexp_replace(x, SPACE + "+", " ")))
    return F.filter(lines, lambda x: x != "")


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def padded(n: Column, width: int = 4) -> Column:
    """With leading zeros to ``width``; longer numbers stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def climbs(path: Column) -> Column:
    return F.array_contains(F.split(path, "/", -1), "..")


def is_test_path(path: Column) -> Column:
    return path.contains("/test/") | path.endswith("_test.go")
