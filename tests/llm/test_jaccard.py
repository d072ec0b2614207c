import random

import numpy as np
import pytest

import corpus_pipeline
from leaselake.llm import jaccard, simhash

from .conftest import DOCS, awkward_rows, words


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


def survivors(rows):
    """Least key of each component of five-word Jaccard 0.8 or more, comparing all pairs; nulls last."""
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append((r[0] is None, r[0] or 0))
    return sorted(min(m) for m in least.values())


def edited(seed, text, share):
    """The text with a run of words replaced, about ``share`` of them."""
    w, rng = text.split(), random.Random(seed)
    k = round(len(w) * share)
    at = rng.randrange(len(w) - k + 1)
    w[at : at + k] = words(seed + 10_000, k).split()
    return " ".join(w)


def corpus(seed):
    """Groups of copies with 2 to 14 % of the words replaced, also copies of copies, and single texts."""
    rng, out = random.Random(seed), []
    for g in range(25):
        group = [words(seed * 1000 + g, rng.randint(60, 300))]
        for _ in range(rng.randint(0, 7)):
            group.append(edited(len(out) * 50 + len(group), rng.choice(group), rng.choice([0.02, 0.05, 0.08, 0.11, 0.14])))
        out += group
    return [(i, t, "en", "src1", len(t)) for i, t in enumerate(out)]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    return sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), dtype=np.uint64) for _ in range(12)]
    got = jaccard.shared(sets[:5], sets[5:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]
    assert jaccard.shared([np.array([1], dtype=np.uint64)], [np.array([2], dtype=np.uint64)]).tolist() == [[0]]


def test_stage_drops_near_copies_that_three_bits_miss(spark):
    rows = corpus(1)
    want = survivors(rows)
    assert kept(spark, rows) == want
    by_bits = simhash.keep_one(spark.createDataFrame(rows, DOCS)).count()
    assert by_bits > len(want)


@pytest.mark.parametrize("block", [2, 5])
def test_large_buckets_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(2)
    base = words(77, 120)
    rows += [(1000 + i, edited(i, base, 0.03 + 0.02 * (i % 6)), "en", "src2", 1) for i in range(40)]
    assert kept(spark, rows) == survivors(rows)


def test_exactly_four_fifths_and_just_below(spark):
    w = words(5, 200).split()
    # 36 of 45 shingles are shared in the first pair, 35 of 45 in the second.
    pairs = [(w[:44], w[4:49]), (w[100:143], w[104:149])]
    rows = [(2 * i + j, " ".join(t), "en", "src1", 1) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    ratios = [len(a & b) / len(a | b) for a, b in ((plain_set(rows[i][1]), plain_set(rows[i + 1][1])) for i in (0, 2))]
    assert ratios[0] == 0.8 and ratios[1] < 0.8
    assert kept(spark, rows) == [(False, 0), (False, 2), (False, 3)]


def test_awkward_rows(awkward, empty):
    left = jaccard.keep_one(awkward)
    assert left.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == survivors(awkward_rows())
    assert jaccard.keep_one(empty).count() == 0


def test_filter_knows_all_marked_keys(spark, monkeypatch):
    from leaselake.llm import common

    for bits in (1 << 26, 1 << 10):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        rows = spark.range(5000).selectExpr("if(id % 50 = 0, null, id) AS id", "id * 7 AS bits", "'own' AS bucket")
        marked = common.key_bits(rows.where("bits % 3 = 0"), "id", "bits")
        told = common.maybe_marked(rows, marked, "told", "id", "bits")
        assert told.columns == [*rows.columns, "told"] and told.count() == 5000
        assert told.where("bits % 3 = 0 and not told").count() == 0
        wrong = told.where("bits % 3 <> 0 and told").count()
        assert wrong < 10 if bits > 1 << 20 else wrong > 1000
