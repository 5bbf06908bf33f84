"""Rows found in texts, file by file: patterns at the starts of lines, without a shuffle and in one reading of the files.

Patterns are those of ``matches`` (Java's with white space spelled out, each beginning with ``^``); Python's engine runs them alike.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .matches import MULTI, WS

#: Files whose rows are in memory at a time.
FILES = 256
_SPACE = "\t\n\f\r "


@lru_cache(maxsize=None)
def compiled(java: str) -> re.Pattern:
    return re.compile(java.removeprefix(MULTI), re.M | re.A)


def line_starts(text: str) -> list[int]:
    """Places where lines start. The line of a place is the number of starts up to it."""
    widths = [len(x) for x in text.split("\n")]
    return list(map(add, accumulate(widths[:-1], initial=0), range(len(widths))))


@lru_cache(maxsize=None)
def fed(java: str) -> re.Pattern | None:
    """A pattern behind the line feed before it, which the engine finds at once; None if it has more than one ``^``, or if
    it can end with the next line feed."""
    whole = java.removeprefix(MULTI)
    return re.compile(r"\n" + whole[1:], re.M | re.A) if whole.startswith("^") and "|^" not in whole and not whole.endswith("$") else None


_BLANK = re.compile(r"\n(?:[\t\f\r ]*+\n){32}")


@lru_cache(maxsize=4)
def long_blank(text: str) -> bool:
    """Whether there are many blank lines together; a search from each of them would pass over all that follow."""
    return _BLANK.search(text) is not None


#: White space, then a word or a choice of few words; of many, every other letter begins one.
_LED = re.compile(re.escape("^" + WS) + r"\*\+?(?=[a-z]{2}(?![?*+{|])|\(\?:[a-z]+(?:\|[a-z]+){0,4}\)(?![?*+{]))")


@lru_cache(maxsize=None)
def led_by_word(java: str) -> re.Pattern | None:
    """Of a pattern that begins with words after white space, what follows the white space; else None."""
    whole = java.removeprefix(MULTI)
    m = _LED.match(whole)
    return re.compile(whole[m.end() :], re.M | re.A) if m and "|^" not in whole else None


def _start(text: str, at: int, low: int) -> int:
    """The first start of a line, from ``low`` on, from which white space leads up to ``at``; -1 if there is none."""
    i = low + len(text[low:at].rstrip(_SPACE))
    if i == 0 or i == low and text[i - 1] == "\n":
        return i
    return text.find("\n", i, at) + 1 or -1


def each_at_lines(java: str, text: str, starts: list[int] | None = None) -> Iterator[tuple[int, re.Match]]:
    """All matches with the places where they start, in order; the text is searched as far as they are asked for.

    As only the start of a line can match, line feeds are searched, with the pattern behind them (``m.start()`` is that place, ``m[0]``
    has the line feed). Where many blank lines stand together, words are searched if the pattern begins with words, and a match itself
    begins after its white space; else the starts of lines are tried.
    """
    behind = fed(java)
    if behind and not long_blank(text):
        m = compiled(java).match(text)
        if m:
            yield 0, m
        for m in behind.finditer(text, m.end() if m else 0):
            yield m.start() + 1, m
        return
    word = led_by_word(java)
    if not word:
        match, end = compiled(java).match, 0
        for s in line_starts(text) if starts is None else starts:
            if s >= end and (m := match(text, s)):
                yield s, m
                end = m.end()
        return
    low, again = 0, 0
    while again >= 0:
        here, again = again, -1
        for m in word.finditer(text, here):
            s = _start(text, m.start(), low)
            if s < 0:  # within a line; it may hide the next one
                low = again = m.start() + 1
                break
            yield s, m
            low = m.end()


def at_lines(java: str, text: str, starts: list[int] | None = None) -> list[tuple[int, re.Match]]:
    return list(each_at_lines(java, text, starts))


def ends_at_lines(java: str, text: str, starts: list[int], only_first: bool = False) -> tuple[tuple[int, re.Match], tuple[int, re.Match]] | None:
    """The first and the last match, or twice the first one; None if there is none."""
    each = each_at_lines(java, text, starts)
    first = next(each, None)
    if only_first:
        return first and (first, first)
    behind = fed(java)
    if first and behind and not long_blank(text):  # the engine passes over those between
        last = deque(behind.finditer(text, first[1].end()), 1)
        return first, (last[0].start() + 1, last[0]) if last else first
    return first and (first, deque(chain([first], each), 1)[0])


def line_of(starts: list[int], at: int) -> int:
    return bisect_right(starts, at)


def rows_of(files: DataFrame, f: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """``schema``, of which the first column is that of ``files``, the others are the rows that ``f`` gives of the other columns."""
    types = [x.dataType.simpleString() for x in StructType.fromDDL(schema).fields[1:]]
    arrow = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    names = [x.name for x in StructType.fromDDL(schema).fields]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, FILES):
                batch = whole.slice(k, FILES)
                at, out = [], []
                for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                    rows = f(*row)
                    at += [i] * len(rows)
                    out += rows
                columns = zip(*out, strict=True) if out else [()] * len(types)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, arrow[t]) for c, t in zip(columns, types, strict=True))], names=names)

    return files.mapInArrow(found, schema)
