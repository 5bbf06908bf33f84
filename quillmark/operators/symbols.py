"""Symbols of source files, by declarative pattern tables for seven languages and one engine.

A rule is a Java pattern, its RE2 form, the group of the name, and how name and kind come about. All rules of a language are
tried on a file when it is read. ``seq`` is the order of emission: rule by rule, in a rule by place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from heapq import heappop, heappush, merge
from itertools import tee
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.matches import MULTI, WS, first_group, line_count
from ..functions.scans import at_lines, each_at_lines, line_of, line_starts, rows_of

W = WS[1:-1]


@dataclass(frozen=True)
class Rule:
    """``owner``: what stands before the name: type, none, default, receiver or match; ``only``: a filter on the match."""

    java: str
    re2: str
    kind: str = "method"
    group: int = 1
    owner: str = "type"
    only: str = ""


@lru_cache(maxsize=None)
def _both(p: str) -> str:
    """Java's form of an RE2 pattern: white space spelled out, and the end of a word, which is where other letters begin too."""
    return MULTI + p.replace(r"\s", WS).replace(r"\b", "(?![A-Za-z0-9_])").removeprefix("(?m)")


def _rule(p: str, **more) -> Rule:
    return Rule(_both(p), "(?m)" + p, **more)


_WORD = r"[A-Za-z0-9_]+"
_MODS = "public|protected|private|static|final|synchronized|native|abstract|default"
_JS = r"[A-Za-z_$][A-Za-z0-9_$]*"
_ID = r"[A-Za-z_][A-Za-z0-9_]*"
_RUN = r"[A-Za-z_][A-Za-z0-9_:<>*&\s]+"
#: Nothing but a run of type characters up to a parenthesis can match; without it the search gives up at once.
_AHEAD = rf"{MULTI}^{WS}*+(?=[A-Za-z_][A-Za-z0-9_:<>*&{W}]*+\()"
#: A run of two characters at least and white space, then a name: in words, so that the name is not sought from the run's end.
_CPP_NAME = rf"{_AHEAD}(?!.{WS}{_ID}{WS}*\()(?:[A-Za-z0-9_:<>*&]++{WS}++)+?({_ID}){WS}*+\("
_CS_MODS = "public|internal|protected|private|static|virtual|override|sealed|async|extern|unsafe|new"

PACKAGE = {
    "java": r"^\s*package\s+([A-Za-z0-9_.]+)\s*;",
    "go": r"^\s*package\s+([A-Za-z0-9_]+)\s*$",
    "kt": r"^\s*package\s+([A-Za-z_][A-Za-z0-9_.]*)",
    "cs": r"^\s*namespace\s+([A-Za-z_][A-Za-z0-9_.]*)",
    "cpp": r"^\s*namespace\s+([A-Za-z_][A-Za-z0-9_:]*)\s*\{",
}
#: (pattern, group of the keyword, group of the name)
TYPE = {
    "java": (r"^\s*(?:public\s+)?(class|interface|enum)\s+([A-Za-z0-9_]+)", 1, 2),
    "kt": (rf"^\s*(?:public\s+|internal\s+|private\s+)?(class|interface|object)\s+({_ID})", 1, 2),
    "cs": (rf"^\s*(?:[A-Za-z]+\s+)*(class|struct|interface|enum)\s+({_ID})", 1, 2),
    "cpp": (rf"^\s*(class|struct|enum)\s+({_ID})\b", 1, 2),
    "py": (rf"^\s*(class)\s+({_ID})\s*\(", 1, 2),
}
TS_CLASS = rf"^\s*export\s+(?:default\s+)?class\s+({_JS})?"
TS_INTERFACE = rf"^\s*export\s+interface\s+({_JS})"
TS_OBJECT = rf"^\s*export\s+const\s+({_JS})\s*=\s*\{{"
TS_MEMBER = rf"^[\t ]*({_JS})\s*\("
TS_REEXPORT = r"""^\s*export\s*\{([^}]*)\}\s*from\s*['"][^'"]+['"]"""
TS_LETVAR = rf"^\s*export\s+(?:let|var)\s+({_JS})\s*="

RULES = {
    "java": [
        # the type may be one of the modifiers itself, so there are two forms of what stands before the name
        Rule(rf"{MULTI}^(?:(?:{_MODS}|{WS}++)++[A-Za-z0-9_<>\[\].?]+|(?:{WS}++|(?:{_MODS}){WS}++)(?:(?:{_MODS}){WS}++)*?(?:{_MODS})){WS}++({_WORD}){WS}*+\(", rf"(?m)^\s*(?:{_MODS}|\s)+\s*[A-Za-z0-9_<>\[\].?]+\s+({_WORD})\s*\("),
        Rule(rf"{MULTI}^(?:public|protected|private|{WS}++)++({_WORD}){WS}*+\(", rf"(?m)^\s*(?:public|protected|private|\s)+\s*({_WORD})\s*\(", kind="ctor", only="type"),
    ],
    "go": [_rule(rf"^\s*func\s+(\([^)]+\)\s*)?({_WORD})\s*\(", group=2, owner="receiver")],
    "ts": [
        _rule(rf"^\s*export\s+(?:async\s+)?function\*?\s+({_JS})\s*\("),
        _rule(rf"^\s*export\s+default\s+function\s+({_JS})\s*\(", owner="default"),
        _rule(r"^\s*export\s+default\s+function\s*\(", group=0, owner="anonymous"),
        _rule(rf"^\s*export\s+const\s+({_JS})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_JS})\s*=>"),
    ],
    "kt": [Rule(rf"{MULTI}^{WS}*(?:suspend{WS}+fun|fun){WS}+(?:{_ID}\.)?({_ID}){WS}*\(", rf"(?m)^\s*(?:suspend\s+)?fun\s+(?:{_ID}\.)?({_ID})\s*\(")],
    "cs": [_rule(rf"^\s*(?:{_CS_MODS})\s+.*?({_ID})\s*\(")],
    "py": [_rule(rf"^\s*def\s+({_ID})\s*\(")],
    "cpp": [
        Rule(rf"{_AHEAD}(?=[A-Za-z0-9_<>*&{W}]*+:)(?:{_RUN.replace(chr(92) + 's', W)})?\b{_ID}::({_ID}){WS}*\(", rf"(?m)^\s*(?:{_RUN})?\b{_ID}::({_ID})\s*\(", owner="qualifier"),
        Rule(_CPP_NAME, rf"(?m)^\s*(?:virtual\s+)?{_RUN}\s+({_ID})\s*\(", only="has type"),
        Rule(_CPP_NAME, rf"(?m)^\s*(?:inline\s+)?{_RUN}\s+({_ID})\s*\(", kind="func", owner="none", only="unqualified"),
    ],
}


def heads(files: DataFrame) -> DataFrame:
    """(path, lang, text, lines, package, class, kind) of files (path, text); files of unknown language have empty values and kind file."""
    t, p = F.col("text"), F.col("path")
    lang = paths.lang_of(p)
    by = lambda f, langs, default: reduce(lambda acc, k: acc.when(lang == k, f(k)), langs[1:], F.when(lang == langs[0], f(langs[0]))).otherwise(default)
    package = by(lambda k: first_group(t, _both(PACKAGE[k])), list(PACKAGE), F.lit(""))
    package = F.when(lang == "cpp", F.regexp_replace(F.replace(package, F.lit("::"), F.lit(".")), "^[:.]+|[:.]+$", "")).when(lang == "py", _python_module(p)).otherwise(package)
    typ = by(lambda k: first_group(t, _both(TYPE[k][0]), TYPE[k][2]), list(TYPE), F.lit(""))
    kind = by(lambda k: first_group(t, _both(TYPE[k][0]), TYPE[k][1]), list(TYPE), F.lit(""))
    ts_class, ts_interface = F.regexp_like(t, F.lit(_both(TS_CLASS))), first_group(t, _both(TS_INTERFACE))
    typ = F.when(lang != "ts", typ).when(ts_class, F.coalesce(F.nullif(first_group(t, _both(TS_CLASS)), F.lit("")), F.lit("default"))).otherwise(ts_interface)
    kind = F.when(lang != "ts", kind).when(ts_class, "class").when(ts_interface != "", "interface").otherwise("")
    # through a generator, so that the optimizer does not put these expressions wherever their columns are used
    row = F.struct(lang.alias("lang"), line_count(t).alias("lines"), package.alias("package"), typ.alias("class"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("file")).alias("kind"))
    return files.select("path", "text", F.inline_outer(F.array(row))).select("path", "lang", "text", "lines", "package", "class", "kind")


def _python_module(path: Column) -> Column:
    folder, name = paths.parent(path), F.regexp_replace(F.substring_index(path, "/", -1), r"\.py$", "")
    return F.concat_ws(".", F.nullif(F.replace(folder, F.lit("/"), F.lit(".")), F.lit("")), F.when(name != "__init__", name))


@lru_cache(maxsize=1 << 16)
def _receiver(whole: str) -> str:
    """Base type of the receiver in a function's head, like ``paths.receiver_type``."""
    m = re.search(rf"func{WS}+(\([^)]+\))", whole)
    inner = re.sub(rf"{WS}+", " ", m[1].strip(" ").removeprefix("(").removesuffix(")").strip(" ")) if m else ""
    return inner.strip(" ").rsplit(" ", 1)[-1].lstrip("*&").split("[", 1)[0].rsplit(".", 1)[-1]


def _qualified(*parts: str) -> str:
    return ".".join([p for x in parts if (p := x.strip(" "))])


def _matched(r: Rule, typ: str, found: Iterable[tuple[int, re.Match]]) -> Iterable[tuple[int, re.Match]]:
    if r.only == "type":
        return (x for x in found if x[1][r.group] == typ)
    return (x for x in found if "::" not in x[1][0]) if r.only == "unqualified" else found


_MEMBER = re.compile(_both(TS_MEMBER).removeprefix(MULTI + "^"), re.A)


def _members(text: str, starts: list[int]) -> Iterator[tuple]:
    """(line, rule, match, object) of members of exported object literals, up to the first closing brace."""
    for _, o in each_at_lines(_both(TS_OBJECT), text, starts):
        if (close := text.find("}", o.end())) >= 0:
            at, end = o.end(), 0
            while True:
                if at >= end and (m := _MEMBER.match(text, at, close)):
                    yield line_of(starts, at), None, m, o
                    end = m.end()
                if not (at := text.find("\n", at, close) + 1):
                    break


def _sources(lang: str, typ: str, text: str, starts: list[int]) -> list[Iterator[tuple]]:
    """What is found of a file's symbols by each rule as (line, rule, match, object), in the order of emission."""

    def primary() -> Iterator[tuple]:  # the primary type of C++ is a symbol itself, before all others
        for s, _ in each_at_lines(_both(TYPE["cpp"][0]), text, starts):
            yield line_of(starts, s), None, None, None
            return

    rules = [r for r in RULES.get(lang, ()) if typ or r.only not in ("has type", "type")]
    shared = {}

    def by_rule(r: Rule) -> Iterator[tuple]:
        found = shared.get(r.java) or each_at_lines(r.java, text, starts)
        if sum(x.java == r.java for x in rules) > 1:
            found, shared[r.java] = tee(found)
        return ((line_of(starts, s), r, m, None) for s, m in _matched(r, typ, found))

    return ([primary()] if lang == "cpp" and typ else []) + [by_rule(r) for r in rules] + ([_members(text, starts)] if lang == "ts" else [])


_LETTERS = ascii_letters + digits + "_"


def _namer(lang: str, package: str, typ: str, kind: str, r: Rule | None) -> Callable[[re.Match, re.Match | None], tuple]:
    """Gives (symbol, kind, export) of what a rule of ``_sources`` matched."""
    if r is None:
        return lambda m, o: (_qualified(o[1], m[1]), "method", None) if o else (_qualified(package, typ), kind, None)
    package = "" if lang == "ts" else package
    g, what = r.group, r.kind

    def under(owner: str) -> str:  # a name has one letter at least, and no blanks
        return x + "." if (x := _qualified(package, owner)) else ""

    if r.owner == "receiver":

        def of(m: re.Match, o: None) -> tuple:
            owner = _receiver("func " + m[1]) if m[1] else ""
            return under(owner) + m[g], "method" if owner else "func", m[g] + "()"

        return of
    if r.owner == "qualifier":  # the word that ends before the name's colons

        def of(m: re.Match, o: None) -> tuple:
            head = m.string[m.start() : m.start(g) - 2]
            return under(head[len(head.rstrip(_LETTERS)) :]) + m[g], what, m[g] + "()"

        return of
    before = under({"type": typ, "default": "default"}.get(r.owner, ""))
    if r.owner == "anonymous":
        return lambda m, o: (before + "default", what, "default()")
    return lambda m, o: (before + (name := m[g]), what, name + "()")


def named(lang: str, package: str, typ: str, kind: str, one: tuple) -> tuple:
    """(symbol, kind, export) of one of ``_sources``."""
    return _namer(lang, package, typ, kind, one[1])(*one[2:])


def emitted(lang: str, package: str, typ: str, kind: str, text: str, starts: list[int]) -> list[tuple]:
    """All symbols of a file as (line, symbol, kind, export), in the order of emission."""
    out = []
    for source in _sources(lang, typ, text, starts):
        of = None
        for line, r, m, o in source:
            of = of or _namer(lang, package, typ, kind, r)
            out.append((line, *of(m, o)))
    return out


def spans(found: list[tuple], lines: int) -> list[tuple]:
    """(start, end, seq), by place, of what begins with a line; each ends before the next, or with the file."""
    by = sorted((x[0], k) for k, x in enumerate(found, 1))
    ends = [x[0] - 1 for x in by[1:]] + [lines]
    return [(start, max(start, end), seq) for (start, seq), end in zip(by, ends, strict=False)]


def placed(found: list[tuple], lines: int) -> list[tuple]:
    """(symbol, kind, start, end, seq, export), by place."""
    return [(*found[seq - 1][1:3], start, end, seq, found[seq - 1][3]) for start, end, seq in spans(found, lines)]


def _by_line(members: Iterator[tuple], starts: list[int]) -> Iterator[tuple]:
    """Members of objects by line, as an object's block can reach over the next one; no member comes before its object."""
    held: list[tuple] = []
    of = None
    for n, x in enumerate(members):
        if x[3] is not of:
            of = x[3]
            here = line_of(starts, of.end())
            while held and held[0][0] <= here:
                yield heappop(held)[2]
        heappush(held, (x[0], n, x))
    while held:
        yield heappop(held)[2]


def first_spans(lang: str, typ: str, text: str, starts: list[int], lines: int, least: int, most: int) -> list[tuple]:
    """(start, end, one of ``_sources``) of symbols of at least ``least`` lines, by place: all that can be among the first ``most``
    of all regions by their start, or all if it is 0. The text is searched as far as these go."""

    def ordered(k: int, source: Iterator[tuple]) -> Iterator[tuple]:
        for i, x in enumerate(source):
            yield x[0], k, i, x

    sources = _sources(lang, typ, text, starts)
    if lang == "ts":
        sources[-1] = _by_line(sources[-1], starts)
    out, before = [], None
    for x in merge(*(ordered(k, s) for k, s in enumerate(sources))):  # the first three differ
        if before and (end := max(before[0], x[0] - 1)) - before[0] + 1 >= least:
            out.append((before[0], end, before[3]))
            if len(out) >= most > 0 and x[0] > out[most - 1][0]:
                return out
        before = x
    if before and (end := max(before[0], lines)) - before[0] + 1 >= least:
        out.append((before[0], end, before[3]))
    return out


#: Columns of ``with_text``, of which ``head`` makes a file's head.
RAW = ("lang", "module", "text")


def with_text(files: DataFrame) -> DataFrame:
    """(path, lang, module, text) of files (path, text): what only the path tells."""
    lang = paths.lang_of(F.col("path"))
    return files.select("path", lang.alias("lang"), F.when(lang == "py", _python_module(F.col("path"))).otherwise("").alias("module"), "text")


def head(lang: str, module: str, text: str, starts: list[int] | None = None) -> tuple:
    """(lang, lines, package, class, kind, text) like ``heads``, in the file's row: patterns are searched up to their first match."""

    def first(p: str) -> re.Match | None:
        return next((m for _, m in each_at_lines(_both(p), text, starts)), None)

    lines = text.count("\n") + 1
    package = (m[1] or "") if lang in PACKAGE and (m := first(PACKAGE[lang])) else module
    if lang == "cpp":
        package = package.replace("::", ".").strip(":.")
    typ = kind = ""
    if lang == "ts":
        if m := first(TS_CLASS):
            typ, kind = m[1] or "default", "class"
        elif m := first(TS_INTERFACE):
            typ, kind = m[1], "interface"
    elif lang in TYPE and (m := first(TYPE[lang][0])):
        kind, typ = m[TYPE[lang][1]], m[TYPE[lang][2]]
    return lang, lines, package, typ, kind or "file", text


def symbols(files: DataFrame, languages: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """(path, symbol, kind, start, end, seq, export) of files (path, text). A symbol ends where the next of its file starts, or with the file.

    A file is one row, and its symbols are found, numbered and ended in it.
    """

    def found(lang: str, module: str, text: str) -> list[tuple]:
        starts = line_starts(text)
        _, lines, package, typ, kind, _ = head(lang, module, text, starts)
        return placed(emitted(lang, package, typ, kind, text, starts), lines)

    some = files.where(paths.lang_of(F.col("path")).isin(*languages) & F.col("text").isNotNull())
    return rows_of(with_text(some), found, "path string, symbol string, kind string, start int, end int, seq int, export string")


def exported(lang: str, typ: str, text: str) -> list[str]:
    """What a file's symbols export in the order of emission, for scripts also re-exported names and variables, in the reference's
    order; C++ names each once. Lines of matches are not needed, and not sought."""
    by: dict[str, list[tuple]] = {}

    def names(r: Rule) -> list[str]:
        if r.java not in by:
            by[r.java] = at_lines(r.java, text)
        return ["default()" if r.owner == "anonymous" else m[r.group] + "()" for _, m in _matched(r, typ, by[r.java])]

    listed = [names(r) for r in RULES.get(lang, ()) if typ or r.only not in ("has type", "type")]
    if lang == "ts":  # an arrow function is emitted after re-exports and variables
        group = lambda p: [m[1] for _, m in at_lines(_both(p), text)]
        items = [n + "()" for x in group(TS_REEXPORT) for y in x.strip(" ").split(",") if (n := y.split(" as ", 1)[0].strip(" "))]
        listed[3:3] = [items, group(TS_LETVAR)]
    flat = [x for part in listed for x in part]
    return list(dict.fromkeys(flat)) if lang == "cpp" else flat


def exports(files: DataFrame) -> DataFrame:
    """(path, exports) of all files, see ``exported``."""

    def found(lang: str, module: str, text: str | None) -> list[tuple]:
        if text is None:
            return [(None if lang == "ts" else [],)]
        typ = head(lang, module, text)[3] if any(r.only for r in RULES.get(lang, ())) else ""
        return [(exported(lang, typ, text),)]

    return rows_of(with_text(files), found, "path string, exports array<string>")
