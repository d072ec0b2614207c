import numpy as np
import pytest
from pyspark.sql import functions as F

from leaselake.llm import sharding as S
from leaselake.llm.common import global_rows

from .conftest import awkward_rows


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    p = S.Permutation(n)
    places = p.forward(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert np.array_equal(p.backward(places), np.arange(n))
    if n > 100:
        assert not np.array_equal(places, S.Permutation(n, 1).forward(np.arange(n)))
        assert abs(np.corrcoef(places, np.arange(n))[0, 1]) < 0.15


def test_global_rows_follow_the_order(spark):
    rows = [(i * 37 % 500, i % 3) for i in range(500)]
    numbered, n = global_rows(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a"])
    got = {r.a: r.row for r in numbered.collect()}
    assert n == 500 and got == {a: a for a in range(500)}


def test_shards_can_be_computed(spark):
    rows = spark.createDataFrame([(i * 37 % 500,) for i in range(500)], "doc_id long")
    got = S.assign_shards(rows, ["doc_id"], 7).collect()
    for r in got:
        assert S.row_at(r.shard, r.slot, 500, 7) == r.doc_id
    again = S.assign_shards(rows.repartition(5), ["doc_id"], 7).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_awkward_rows(spark, awkward, empty, tmp_path):
    got = S.assign_shards(awkward.select("doc_id", "shard", F.length("text").alias("size")), ["doc_id", "size"], 4)
    rows = got.collect()
    assert len(rows) == len(awkward_rows()) and set(got.columns) == {"doc_id", "size", "shard", "slot"}
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert S.assign_shards(empty.select("doc_id"), ["doc_id"]).count() == 0
    S.write_shards(got, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
