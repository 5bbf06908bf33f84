"""URL filter: a trie over reversed host labels and path segments, broadcast; the longest fitting rule decides."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: A trie of more rules than this (some 300 bytes each) is not broadcast: ``judge_urls`` then joins by rule key.
MAX_BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple[int, int, bool]:
        """Longest first; of equal ones the longer path, then block before allow."""
        return len(self.key), len(self.path), self.action == "block"


#: (action, host, path)
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


@dataclass
class _Segment:
    next: dict[str, "_Segment"] = field(default_factory=dict)
    ends: dict[str, Rule] = field(default_factory=dict)  # by the start of the following segment that is asked for
    lengths: tuple[int, ...] = ()


@dataclass
class _Label:
    next: dict[str, "_Label"] = field(default_factory=dict)
    paths: _Segment | None = None


class UrlTrie:
    """Host labels from the last to the first lead to a trie of path segments; a rule's last segment may be the start of a url's."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Label()
        for rule in rules:
            at = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                at = at.next.setdefault(label, _Label())
            at.paths = seg = at.paths or _Segment()
            *whole, last = rule.path.split("/")
            for x in whole:
                seg = seg.next.setdefault(x, _Segment())
            if last not in seg.ends or rule.rank > seg.ends[last].rank:
                seg.ends[last] = rule
            seg.lengths = tuple(sorted({len(x) for x in seg.ends}))

    def find(self, host: str, path: str) -> Rule | None:
        best, at, segments = None, self.root, path.split("/")
        for label in [None, *(reversed(host.split(".")) if host else ())]:
            if label is not None:
                at = at.next.get(label)
                if at is None:
                    break
            seg = at.paths
            for x in segments:
                if seg is None:
                    break
                for n in seg.lengths:
                    rule = seg.ends.get(x[:n]) if n <= len(x) else None
                    if rule and (best is None or rule.rank > best.rank):
                        best = rule
                seg = seg.next.get(x)
        return best


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, r"(?s)://([^/?#]*)", 1)), F.regexp_extract(u, r"(?s)://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, url_col: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """``pages`` with columns host, path, rule (null where none fits) and verdict (``default`` where none fits).

    Columns of these names are replaced; rows, repeated ones too, are kept as they are. Null or malformed urls have an empty
    host and path, which only a rule with an empty host and an empty path fits.
    """
    rules = list(rules)
    host, path = split_url(F.col(url_col))
    d = pages.select(*[c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")], host.alias("host"), path.alias("path"))
    if len(rules) > max_broadcast:
        return _judge_by_join(d, rules, default)
    trie = d.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.find(h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"rule": pd.Series([r.key if r else None for r in found], dtype=object), "verdict": [r.action if r else default for r in found]})

    q = fresh(d, "_q")
    return d.withColumn(q, judged("host", "path")).select("*", f"{q}.rule", f"{q}.verdict").drop(q)


def _judge_by_join(d: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """For rule sets that are too large to broadcast: each distinct (host, path) meets the rules of its host's parents by an equi-join."""
    r = d.sparkSession.createDataFrame([(x.host, x.path, x.action, x.key, *x.rank) for x in rules], "r_host string, r_path string, action string, key string, n int, p int, b boolean")
    labels = F.split("host", r"\.")
    parents = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.array(F.lit("")))
    u = d.select("host", "path").distinct().withColumn("r_host", F.explode_outer(F.array_distinct(parents)))
    q = fresh(d, "_q")
    best = u.join(r, "r_host").where(F.col("path").startswith(F.col("r_path"))).groupBy("host", "path").agg(F.max(F.struct("n", "p", "b", "key", "action")).alias(q))
    return d.join(best, ["host", "path"], "left").select(*d.columns, F.col(f"{q}.key").alias("rule"), F.coalesce(f"{q}.action", F.lit(default)).alias("verdict"))
