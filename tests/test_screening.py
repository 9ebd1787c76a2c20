"""The screening queries against their SQL, and their operators on small tables."""

import glob
import math
import os

import duckdb
import pytest

from caseloom.functions import text as X
from caseloom.operators import evidence as E
from caseloom.operators.vectors import top_matches
from caseloom.plans import screening

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, int | float) else str(v)


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(screening.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = screening.QUERIES[name](spark, SF)
    want = duck.execute(screening.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert comparable(df.columns, df.collect()) == comparable(columns, want.fetchall())


def test_running_total_of_a_hot_group(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(5_000)] + [("b", 3, 1), (None, 1, 1), ("b", None, 1)], "g string, k bigint, n int")
    got = {(r.g, r.k): r.t for r in E.running_total(df, "g", "k", df["n"], "t", width=100).collect()}
    total = 0
    for i in range(5_000):
        assert got["a", i] == total
        total += i % 7
    assert got["b", 3] == 0 and len(got) == 5_001


def test_latest_and_first(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, 7, "y"), (2, None, "z"), (None, 1, "n")], "k int, t int, v string")
    assert sorted(r.v for r in E.latest(df, "k", "t").collect()) == ["n", "y", "z"]
    assert sorted(r.v for r in E.first_seen(df, ["k"], ["t", "v"]).collect()) == ["n", "x", "z"]
    assert E.latest(df.limit(0), "k", "t").count() == 0


def test_unique_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "base string, o int")
    assert [r.slug for r in E.unique_names(df, "base", "o", "slug").orderBy("o").collect()][:3] == ["a", "a-2", "b"]


@pytest.mark.parametrize(("raw", "want"), [("123456", "00123456"), (" sc 123456 ", "SC123456"), ("12345", None), ("ABC12345", None), (None, None), ("", None)])
def test_company_number(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "n string")
    assert df.select(X.company_number(df["n"])).first()[0] == want


def test_top_matches_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    m = rng.standard_normal((300, 8))
    m[7] = 0
    rows = [(i, m[i].tolist()) for i in range(300)] + [(300, None)]
    got = top_matches(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 4).collect()
    for q in range(0, 300, 50):
        cos = [(-round(float(m[q] @ m[i] / np.linalg.norm(m[q]) / np.linalg.norm(m[i])), 6), i) for i in range(300) if i not in (q, 7)]
        assert {r.vec_id for r in got if r.query_id == q} == {i for _, i in sorted(cos)[:4]}
    assert top_matches(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), 4).count() == 0
