import unicodedata
import zlib

import numpy as np

from leaselake.llm import langid as L

from .conftest import awkward_rows, lines, words


def plain_vector(text):
    """Sum of bound trigram vectors, one trigram at a time."""
    is_letter = lambda c: unicodedata.category(c)[0] == "L"
    text = f"\n{text.lower()}\n"
    kept = [c if is_letter(c) else " " for i, c in enumerate(text) if any(is_letter(x) for x in text[max(0, i - 1) : i + 2])]
    out = np.zeros(L.DIMENSIONS)
    vector = lambda c: 1 - 2 * L.letter_bits(np.array([ord(c)]))[0].astype(float)
    for a, b, c in zip(kept, kept[1:], kept[2:]):
        out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_vectors_match_the_definition(monkeypatch):
    texts = ["Ab cd.ef", "", "é", "日本語 abc", "a1b--c", "x\n\ny"]
    want = np.array([plain_vector(t) for t in texts])
    assert np.array_equal(L.document_vectors(texts), want)
    monkeypatch.setattr(L, "BLOCK", 3)
    assert np.array_equal(L.document_vectors(texts), want)
    texts += ["a long word cut within", "...gaps -- of -- all  kinds... ", "\n\nx--------------------y z", "日本語 " * 9, "-" * 30, "ab"]
    want = np.array([plain_vector(t) for t in texts])
    for piece in (1, 2, 3, 5, 8, 20):
        monkeypatch.setattr(L, "PIECE", piece)
        assert np.array_equal(L.document_vectors(texts), want)
    owners = [i % 3 for i in range(len(texts))]
    together = np.array([want[[i for i, o in enumerate(owners) if o == k]].sum(axis=0) for k in range(3)])
    assert np.array_equal(L.document_vectors(texts, owners, 3), together)


def test_letter_vectors_are_nearly_orthogonal():
    v = 1 - 2 * L.letter_bits(np.arange(97, 123)).astype(float)
    cosine = v @ v.T / L.DIMENSIONS
    assert np.abs(cosine - np.eye(26)).max() < 0.2


def test_held_out_documents(spark):
    langs = ["en", "de", "fr"]
    rows = [(i, lines(i, 3, langs[i % 3]), langs[i % 3] if i % 10 else None) for i in range(240)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(got[i].lang_pred == langs[i % 3] and 0 < got[i].score <= 1 for i in got)


def test_awkward_rows(awkward, empty):
    got = L.identify(awkward).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        assert 0 <= r.score <= 1
    none = [r for r in awkward_rows() if not any(unicodedata.category(c)[0] == "L" for c in r[1] or "")]
    assert sum(r.lang_pred == "und" for r in got) == len(none) and all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = L.keep_identified(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(got) - len(none)
    assert L.identify(empty).count() == 0 and L.keep_identified(empty).count() == 0
    unlabelled = awkward.withColumn("lang", awkward.lang.substr(9, 1)).where("lang is null")
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} <= {"und"}


def test_identified_language_decides(spark, monkeypatch):
    """Texts like no learned language go, and ``lang`` is what was found; too few letters to tell leave it as given."""
    monkeypatch.setattr(L, "LEAST_LEARNED", 100)
    langs = ["en", "de", "fr"]
    docs = [(i, words(i, 30, langs[i % 3]), langs[i % 3]) for i in range(450)]
    docs += [(1000 + i, words(9000 + i, 30, langs[i % 3]), langs[(i + 1) % 3] if i % 2 else None) for i in range(12)]
    strange = ["".join(chr(1072 + (7 * i * i + 3 * j * j + j) % 32) + " " * (j % 6 == 5) for j in range(700)) for i in range(4)]
    given = next(i for i in range(2100, 2200) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs += [(2000, strange[0], None), (2001, strange[1], None), (given, strange[2], "en"), (None, strange[3], "de")]
    docs += [(3000, "ж", "fr"), (3001, "ж", None), (3002, "12 34", "en"), (3003, None, "en"), (None, words(9100, 30, "de"), None)]
    rows = [(key, text, lang, f"own {key}") for key, text, lang in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    kept = L.keep_identified(df)
    assert kept.columns == df.columns
    out = kept.collect()
    got = {r.doc_id: r for r in out}
    want = {i: langs[i % 3] for i in range(450)} | {1000 + i: langs[i % 3] for i in range(12)} | {3000: "fr", None: "de"}
    assert len(out) == len(got) and set(got) == set(want) | {3001} and got[3001].lang in langs
    assert {key: got[key].lang for key in want} == want
    assert {(key, r.text, r.score) for key, r in got.items()} <= {(key, text, own) for key, text, _, own in rows}


def test_sizes_that_tell(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAST_LEARNED", 100)
    rows = [(3, 0.05)] * 2 + [(3, 0.5)] * 198 + [(5, 0.5)] * 100 + [(6, 0.01)] * 99 + [(9, 0.01)] + [(9, 0.5)] * 998
    assert L.told_classes(spark.createDataFrame(rows, "letters int, score double")) == [5, 6, 7, 8]
    assert L.told_classes(spark.createDataFrame(rows + [(9, 0.5)], "letters int, score double")) == list(range(5, 32))
    assert L.told_classes(spark.createDataFrame([], "letters int, score double")) == []
