import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaselake.llm import hard_negatives

from tests.compare import connect, difference

ROWS = "vec_id long, embedding array<float>, label int, row string, cell string, is_anchor string"


def plain(rows):
    sound = [
        (k, lab, [math.floor(256 * x) for x in v]) for k, v, lab, *_ in rows
        if k is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, (key, label, vector) in enumerate(sound):
        if key % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, w)), k, lab, j) for j, (k, lab, w) in enumerate(sound) if j != i)
        for p, positive, _, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(key, positive, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fit[:3])]
    return sorted(out)


def some(seed, n, size=6, scale=1.0):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(size)], rng.randrange(3), "a", "b", "c") for i in range(n)]


def got(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect())


@pytest.mark.parametrize("blocks", [(512, 4096, 256), (2, 37, 5)])
def test_against_plain_python(spark, monkeypatch, blocks):
    for name, value in zip(("ANCHORS", "CANDIDATES", "PACKED"), blocks):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some(1, 310)
    assert plain(rows)
    assert got(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = some(2, 160)
    rows += rows[50:55] + rows[100:101] * 3
    rows += [(200, None, 1, "", "", ""), (None, [1.0] * 6, 1, "", "", ""), (250, [1.0] * 6, None, "", "", ""), (300, [1.0, None] * 3, 1, "", "", ""),
             (350, [float("nan")] * 6, 1, "", "", ""), (400, [float("inf")] * 6, 1, "", "", ""), (450, [], 1, "", "", ""), (500, [2.0], 0, "", "", "")]
    rows += [(600 + i, [0.5, 0.5, -0.5, 0.0, 1.0, 0.25], i % 3, "", "", "") for i in range(60)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_scores_of_any_size(spark):
    rows = some(3, 110, 4, 1e4)
    assert got(spark, rows) == plain(rows)
    # Scores beyond a long are compared exactly and given as its end.
    rows = some(4, 60, 4, 1e15)
    end = 2**63 - 1
    want = sorted((*w[:4], min(w[4], end), min(w[5], end)) for w in plain(rows))
    assert want and got(spark, rows) == want


@pytest.mark.parametrize("scale", [1, 10**4, 10**12, 10**40])
def test_packed_products(scale):
    rng = random.Random(scale)
    rows = [[rng.randint(-scale, scale) for _ in range(rng.choice([5, 5, 3, 0]))] for _ in range(23)]
    anchors = [[rng.randint(-scale, scale) for _ in range(5)] for _ in range(7)] + [[0] * 5, [-scale] * 5, []]
    table = hard_negatives.score_table(anchors, rows)
    assert [[int(v) for v in line] for line in table] == [[sum(a * b for a, b in zip(x, y)) for y in rows] for x in anchors]


def test_query_against_sql(spark):
    from leaselake.llm import queries

    small = "/root/testdata/sf0.001"
    name = "op13_kronecker_negatives"
    assert difference(spark, connect(small), queries.queries()[name], queries.oracle_sql()[name], small) == ""
