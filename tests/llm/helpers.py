"""What the tests of this folder share."""

import os
import re

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that clash in case with what operators add, or with names that they use inside.
EXTRA = ", id string, key string, X string, Span string, score_ string"
EXTRA_VALUES = ("i", None, "x", "s", "t")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def duck(sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def canonical(df):
    def text(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, float):
            return repr(round(x, 9)) if x != int(x) else str(int(x))
        return str(x)

    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(a, b):
    a, b = canonical(a), canonical(b)
    assert list(a.columns) == list(b.columns)
    pd.testing.assert_frame_equal(a, b)


def documents(spark, rows):
    """(doc_id, text) pairs with extra columns of clashing names."""
    return spark.createDataFrame([(*r, *EXTRA_VALUES) for r in rows], "doc_id long, text string" + EXTRA)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
