"""Which files of a tree count."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

EXTENSIONS = (".java", ".go", ".ts", ".tsx", ".js", ".kt", ".cs", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".h", ".md", ".json", ".yml", ".yaml", ".xml", ".gradle", ".properties", ".txt")
EXCLUDES = (".git", "node_modules", "build", "out", "dist", "target", ".idea", ".gradle", "vendor")


@dataclass(frozen=True)
class IgnoreRule:
    negated: bool
    folder_only: bool
    regex: str


def ignore_rules(text: str) -> list[IgnoreRule]:
    """Rules of an ignore file: ``#`` comments, ``!`` negation, a leading slash anchors, a trailing one means folders; ``**`` is anything,
    ``*`` and ``?`` stay in a segment. There are no character classes and no escapes."""
    out = []
    for line in text.split("\n"):
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[1:] if negated else p
        anchored = p.startswith("/")
        p = p.lstrip("/") if anchored else p
        folder = p.endswith("/")
        p = p.rstrip("/") if folder else p
        if not p:
            continue
        body, i = "", 0
        while i < len(p):
            if p.startswith("**", i):
                body, i = body + ".*", i + 2
            elif p[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif p[i] == "?":
                body, i = body + "[^/]", i + 1
            else:
                body, i = body + re.escape(p[i]), i + 1
        out.append(IgnoreRule(negated, folder, ("^" if anchored else "^(.*/)?") + body + "$"))
    return out


def has_extension(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """True for all if there are none. Upper case in ``extensions`` matches nothing."""
    return F.lit(True) if not extensions else paths.extension(path).isin(*extensions)


def is_included(absolute: Column, includes: tuple[str, ...]) -> Column:
    """Whether a path has one of the parts, in whatever case."""
    out = F.lit(False)
    for x in includes:
        out = out | F.contains(F.lower(absolute), F.lit(x.lower()))
    return out


def is_excluded(path: Column, prefixes: tuple[str, ...] = EXCLUDES) -> Column:
    """Whether a segment begins with one of the prefixes, so ``build`` takes build.gradle too."""
    if not prefixes:
        return F.lit(False)
    pattern = "(^|/)(" + "|".join(re.escape(p) for p in prefixes) + ")"
    return path.rlike(pattern)


def is_ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """The last fitting rule decides, for the path and for each folder above it (and the root, ``.``): what is below an ignored folder cannot come back."""
    if not rules:
        return F.lit(False)

    def decided(p: Column, folder: bool) -> Column:
        out = None
        for r in reversed(rules):
            if r.folder_only and not folder:
                continue
            hit = p.rlike(r.regex)
            out = F.when(hit, F.lit(not r.negated)) if out is None else out.when(hit, F.lit(not r.negated))
        return F.lit(False) if out is None else out.otherwise(False)

    parts = F.split(path, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    return decided(F.lit("."), True) | F.exists(folders, lambda p: decided(p, True)) | decided(path, False)


def kept_files(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, excludes: tuple[str, ...] = EXCLUDES, includes: tuple[str, ...] = (), rules: list[IgnoreRule] | None = None, max_file_bytes: int = 2_000_000) -> DataFrame:
    """Files (path, size, and abs_path if there are includes) that pass all rules; includes save from the extensions only."""
    named = has_extension(F.col("path"), extensions)
    if includes:
        named = named | is_included(F.col("abs_path"), includes)
    out = files.where(named & ~is_excluded(F.col("path"), excludes))
    if rules:
        out = out.where(~is_ignored(F.col("path"), rules))
    return out.where(F.col("size") <= max_file_bytes) if max_file_bytes > 0 else out


def walk_order(path: Column) -> Column:
    """Sorting by it gives the order of a walk that goes through each folder's entries by name."""
    return F.split(path, "/", -1)
