import random

import numpy as np
import xxhash

from leaselake.llm import golay, simhash
from leaselake.llm.components import connected_components

from .conftest import awkward_rows, lines


def plain_fingerprint(text):
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, most=3):
    """Least index of each value's component, comparing all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= most:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(values))]


def test_code_is_perfect_and_neighbours_share_an_index():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 500).astype(np.int32)
    assert set(golay.decode(np.arange(1 << 23, dtype=np.int32))) == set(range(4096))
    near = golay.nearby(words)
    assert {len(set(r)) for r in near.tolist()} == {1, 6}
    for bit in range(23):
        moved = golay.decode(words ^ np.int32(1 << bit))
        assert all(m in row for m, row in zip(moved, near))
    errors = words.copy()
    codewords = words ^ golay._tables()[2][golay.syndrome(words)]
    assert (np.bitwise_count(errors ^ codewords) <= 3).all()


def test_fingerprints():
    for text in ("", " \n", "one", "one two", "One TWO three", lines(1, 30), "É é Ä " * 9, "a b c " * 50):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def dense(seed, n):
    """Fingerprints in clusters: many that differ by few bits."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = rng.getrandbits(64) if not out or rng.random() < 0.1 else rng.choice(out)
        for _ in range(rng.randint(0, 5)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return sorted(set(out))


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def components_of(spark, values):
    distinct = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(simhash.connections(distinct)).collect()}
    return {v: root.get(v, v) for v in values}


def same_classes(got, values):
    want = groups(values)
    assert len(set(got.values())) == len(set(want))
    assert len({(got[v], w) for v, w in zip(values, want)}) == len(set(want))


def test_components_match_all_pairs(spark):
    values = dense(1, 700)
    same_classes(components_of(spark, values), values)


def test_busy_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(5)
    values = sorted({0x123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(300)})
    same_classes(components_of(spark, values), values)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(None, 3), (200, 200), (100, 101)], "x long, y long")
    got = {r.node: r.root for r in connected_components(chain).collect()}
    assert got == dict.fromkeys(range(61), 0) | {100: 100, 101: 100}
    assert connected_components(chain.limit(0)).count() == 0


def test_awkward_rows(awkward, empty):
    rows = awkward_rows()
    prints = [plain_fingerprint(r[1] or "") for r in rows]
    root = groups(prints)
    want = []
    for r, p, own in zip(rows, prints, root):
        members = [s[0] for s, o in zip(rows, root) if o == own and s[0] is not None]
        want.append((str(r[0]), f"{p:016x}", min(members, default=None)))
    got = [(str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(awkward).collect()]
    assert sorted(got) == sorted(want)
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len(set(root)) and {plain_fingerprint(t or "") for _, t in left} <= set(prints)
    assert sorted(str(d) for d, _ in left) == sorted(
        str(min((r[0] for r, o in zip(rows, root) if o == own and r[0] is not None), default=None)) for own in set(root)
    )
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
