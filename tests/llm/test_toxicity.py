import random
import zlib

import numpy as np

from leaselake.llm import toxicity as X

from .conftest import awkward_rows, lines, words

BAD = ["wrozzle", "snarkip", "blugfat"]


def corpus(n):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        text, toxic = lines(i, 6), int(rng.random() < 0.3)
        if toxic:
            w = text.split(" ")
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
            text = " ".join(w)
        rows.append((i, text, toxic))
    return rows


def in_fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_features_are_hashed_grams(monkeypatch):
    text = "Ab\ncd é"
    want = {sum_of(f" {text.lower()} ".replace("\n", " ")[i : i + n]) for n in X.SIZES for i in range(len(text) + 3 - n)}
    assert {int(v) for g in X.grams(text) for v in g} == want
    assert list(X.grams("")) == []
    whole = [sorted(int(v) for g in X.grams(text + " Tail word") for v in g)]
    for size in (1, 2, 3, 4, 5, 7, 8):
        monkeypatch.setattr(X, "PIECE", size)
        whole.append(sorted(int(v) for g in X.grams(text + " Tail word") for v in g))
    assert all(w == whole[0] for w in whole)


def sum_of(gram):
    value = ord(gram[0])
    for c in gram[1:]:
        value = (value * int(X._STEP) + ord(c)) % (1 << 32)
    return ((value ^ (value >> 15)) * int(X._MIX) % (1 << 32)) >> (32 - X.BITS)


def test_learns_held_out_labels_and_ignores_their_values(spark):
    rows = corpus(500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.classify(docs, labels).collect()}
    assert all(got[i].held_out == in_fold(i) for i, _, _ in rows)
    held = [(got[i], y) for i, _, y in rows if in_fold(i)]
    assert sum(r.predicted == y for r, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    # Labels of the held-out fold change nothing.
    turned = spark.createDataFrame([(i, 1 - y if in_fold(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in X.classify(docs, turned).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)


def test_training_rows_are_bounded_and_whole_text_counts(spark):
    docs = spark.createDataFrame([(i, words(i, 9)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    assert X.training_rows(docs, labels, "doc_id", "text", "toxic", 10).count() == 10
    features = np.array(sorted({int(v) for g in X.grams("blugfat") for v in g}))
    model = X.Model(features, np.ones(len(features)), -9.0)
    assert model.score(words(1, 40_000)) < 0.1
    assert model.score(words(1, 40_000) + " blugfat") > 0.9


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i in range(20)] + [(106, None)], "doc_id long, toxic int")
    got = X.classify(awkward, labels).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and in_fold(r.doc_id)) for r in got)
    assert X.classify(empty, labels).count() == 0
    assert {r.score for r in X.classify(awkward, labels.limit(0)).collect()} == {0.5}
    model = X.Model(np.zeros(0, dtype=int), np.zeros(0), 0.0)
    scored = X.score(awkward, model, name="probability")
    assert scored.columns == [*awkward.columns, "probability"]
