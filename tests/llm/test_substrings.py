import random

import numpy as np
import pytest

from leaselake.llm import queries, substrings

from .conftest import DOCS, awkward_rows, words


def plain(rows, window=13):
    """(key, words, removed, kept) of every row, by all windows of all rows."""
    split = [(k, (t or "").encode().split()) for k, t in rows]
    least = {}
    for k, w in split:
        for i in range(len(w) - window + 1):
            if k is not None:
                least[tuple(w[i : i + window])] = min(k, least.get(tuple(w[i : i + window]), k))
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and least[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), b" ".join(v for i, v in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def got(docs):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(docs).collect()), key=repr)


def corpus(seed, n=60):
    """Texts of few words with passages cut out of earlier ones, some with a changed word inside."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        own = words(seed * 100 + i, rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 3)):
            if texts:
                other = rng.choice(texts).split()
                at, size = rng.randrange(max(1, len(other))), rng.randint(8, 40)
                piece = other[at : at + size]
                if piece and rng.random() < 0.4:
                    piece[rng.randrange(len(piece))] = "changed"
                place = rng.randrange(len(own) + 1)
                own[place:place] = piece
        texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    keys = list(range(n))
    rng.shuffle(keys)
    return [(k, t, "en", "src1", len(t)) for k, t in zip(keys, texts)]


@pytest.mark.parametrize("busy", [0, 3, 1024])
def test_against_all_windows(spark, monkeypatch, busy):
    monkeypatch.setattr(substrings, "BUSY", busy)
    rows = corpus(busy)
    assert got(spark.createDataFrame(rows, DOCS).repartition(5)) == plain([r[:2] for r in rows])


def test_rows_without_a_key_take_no_part(spark):
    passage = words(8, 40)
    rows = [(0, words(1, 20) + " " + passage[:60], None, None, 0), (None, passage, None, None, 0), (5, words(2, 9) + " " + passage, None, None, 0), (0, passage[20:], None, None, 0)]
    assert got(spark.createDataFrame(rows, DOCS)) == plain([r[:2] for r in rows])


def test_repetitive_texts_and_long_words(spark):
    rows = [(i, " ".join(["a b a"] * (5 + i)) + " " + "z" * 100 * i, None, None, 0) for i in range(8)]
    rows += [(20, " ".join(f"{'w' * 70}{i}" for i in range(30)), None, None, 0), (21, " ".join(f"{'w' * 70}{i}" for i in range(9, 40)), None, None, 0)]
    assert got(spark.createDataFrame(rows, DOCS)) == plain([r[:2] for r in rows])


def test_awkward_rows(awkward, empty):
    out = substrings.remove_repeats(awkward)
    assert out.columns == [*awkward.columns, "n_words", "n_removed"]
    assert got(awkward) == plain([r[:2] for r in awkward_rows()])
    assert substrings.remove_repeats(empty).count() == 0


def test_pieces_do_not_cut_words(monkeypatch):
    text = words(3, 300).encode()
    whole = substrings.word_hashes(text)
    monkeypatch.setattr(substrings, "PIECE", 7)
    assert np.array_equal(substrings.word_hashes(text), whole) and len(whole) == 300


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghi") for _ in range(n)).encode() for n in (0, 6, 7, 2000, 3, 2000)]
    found = substrings.Windows(texts, 7)
    seen, prints, covered = {}, {}, 0
    for owner, first, end, block, own in zip(found.owner, found.first, found.end, found.block, found.prints):
        w = texts[owner].split()
        first, end = first - found.start[owner], end - found.start[owner]
        for i in range(first, end - 6):
            assert seen.setdefault(tuple(w[i : i + 7]), block) == block
            covered += 1
        assert prints.setdefault(tuple(w[first:end]), own) == own
    assert covered == sum(max(0, len(t.split()) - 6) for t in texts)
    assert len(set(prints.values())) == len(prints)


def test_factors_look_across_their_ends():
    block = substrings.Block(3)
    block.add(b"a b c d e".split())
    block.add(b"d e f g".split())
    assert block.factors(b"x a b c d e f g h".split()) == [(1, 6), (4, 8)]
    assert substrings.Block(3).factors(b"a b c".split()) == []


def test_query(spark, folder):
    rows = corpus(9)
    path = folder("substrings", documents=spark.createDataFrame(rows, DOCS))
    import hashlib

    want = sorted((k, n, r, hashlib.sha256(t.encode()).hexdigest()) for k, n, r, t in plain([r[:2] for r in rows]))
    assert sorted(tuple(r) for r in queries.op11_lempel_ziv_dedup(spark, path).collect()) == want
