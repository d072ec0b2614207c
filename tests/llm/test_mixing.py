import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from leaselake.llm import mixing as M

from .conftest import awkward_rows

WEIGHTS = "domain string, lang string, source string, weight int"


def filled(budget, nodes):
    """Water filling by repeated passes, exact: nodes of (name, capacity, weight)."""
    out, left, live = {}, Fraction(budget), list(nodes)
    while live:
        total = sum(w for _, _, w in live)
        full = [n for n in live if n[1] * total <= n[2] * left]
        if not full:
            return out | {n: left * w / total for n, _, w in live}
        for n, c, _ in full:
            out[n] = Fraction(c)
        left -= sum(c for _, c, _ in full)
        live = [n for n in live if n not in full]
    return out


def budgets(spark, leaves, weights, percent, epochs):
    supply = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    rows = M.leaf_budgets(supply, spark.createDataFrame(weights, WEIGHTS), percent, epochs).collect()
    return {(r.domain, r.lang, r.source): r.budget for r in rows}


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 2000)]
    got = budgets(spark, leaves, [], 50, 1)
    # Half of 4,010 to each domain, half of that to x: 10 for the short source, the rest to its sibling.
    assert got[("a", "x", "1")] == 10 and got[("a", "x", "2")] in (491, 492) and sum(got.values()) == 2005
    short = budgets(spark, [("a", "x", "1", 10), ("a", "y", "1", 20), ("b", "x", "1", 5000)], [("a", None, None, 9)], 50, 1)
    assert short == {("a", "x", "1"): 10, ("a", "y", "1"): 20, ("b", "x", "1"): 2485}


@pytest.mark.parametrize("seed", range(3))
def test_budgets_match_exact_water_filling(spark, seed):
    rng = random.Random(seed)
    leaves = [(d, l, s, int(10 ** rng.uniform(0, 6))) for d in "ab" for l in "xyz" for s in "123" if rng.random() < 0.8]
    weights = [("a", None, None, 3), ("a", "x", None, 5), ("b", "z", "1", 4), ("b", "y", None, 0)]
    named = {tuple(w[:3]): w[3] for w in weights}
    leaves_live = [v for v in leaves if v[:2] != ("b", "y")]
    total = min(sum(v[3] for v in leaves_live) * 90 // 100, 2 * sum(v[3] for v in leaves_live))
    want, pools = {}, {(): Fraction(total)}
    for depth in (1, 2, 3):
        for parent in {v[: depth - 1] for v in leaves_live}:
            nodes = sorted({v[:depth] for v in leaves_live if v[: depth - 1] == parent})
            share = filled(pools[parent], [
                (n, 2 * sum(v[3] for v in leaves_live if v[:depth] == n), named.get((*n, *[None] * (3 - depth)), 1)) for n in nodes
            ])
            pools.update(share)
    want = {v[:3]: pools[v[:3]] for v in leaves_live}
    got = budgets(spark, leaves, weights, 90, 2)
    assert sum(got.values()) == total and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 3 for k in want)
    assert all(got[v[:3]] <= 2 * v[3] for v in leaves_live)


@pytest.mark.parametrize("rows_a_slice", [10_000, 3])
def test_same_as_sql(spark, monkeypatch, rows_a_slice):
    monkeypatch.setattr(M, "SLICE_ROWS", rows_a_slice)
    monkeypatch.setattr(M, "SLICE_DIGITS", 1 if rows_a_slice == 3 else 3)
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(0, 30)) or None, rng.choice(["x", "y", None]), rng.choice(["s1", "s1", "s1", "s2", "t1", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = [("s", None, None, 2), ("s", "x", None, 3), ("s", "x", "s2", 7)]
    domain = F.when(F.col("source").like("s%"), "s").otherwise("other")
    got = M.select(docs, spark.createDataFrame(weights, WEIGHTS), 120, 3, domain)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    sql = M.oracle("CASE WHEN source LIKE 's%' THEN 's' ELSE 'other' END", weights, 120, 3)
    columns = ["doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken"]
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, con.execute(sql).fetchall()))


def test_awkward_rows(spark, awkward, empty):
    none = spark.createDataFrame([], WEIGHTS)
    got = M.select(awkward, none, 70, 2, F.lit(None).cast("string"))
    assert [c for c in got.columns if c not in M.ADDED] == awkward.columns
    tokens = sum(len((r[1] or "").encode().split()) for r in awkward_rows())
    assert got.agg(F.sum("taken")).first()[0] == tokens * 70 // 100
    everything = M.select(awkward, none, 500, 2, F.col("source"), added=None)
    assert everything.columns == awkward.columns
    assert everything.count() == 2 * sum(bool((r[1] or "").split()) for r in awkward_rows())
    assert M.select(empty, none, 70, 2, F.col("source")).count() == 0
