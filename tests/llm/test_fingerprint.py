import hashlib

import numpy as np
from pyspark.sql import functions as F

from leaselake.llm import fingerprint as FP

from .conftest import awkward_rows, lines


def test_order_does_not_matter_and_paragraphs_come_and_go():
    a = FP.fingerprint_of([b"one", b"two", b"three"])
    assert a.text() == FP.fingerprint_of([b"three", b"one", b"two"]).text()
    assert a.text() != FP.fingerprint_of([b"one", b"two", b"two", b"three"]).text()
    assert (a - FP.fingerprint_of([b"two"])).text() == FP.fingerprint_of([b"one", b"three"]).text()
    assert FP.Fingerprint.of_text(a.text()).text() == a.text()


def test_likeness_follows_the_shared_share():
    text = lines(1, 40).split("\n")
    whole = FP.fingerprint_of([t.encode() for t in text])
    near = [FP.likeness(whole, FP.fingerprint_of([t.encode() for t in text[:n] + lines(2, 40 - n).split("\n")])) for n in (40, 30, 20, 1)]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3]
    assert 0.6 < near[1] < 0.9 and near[3] < 0.2


def test_lanes_past_two_bytes_do_not_wrap():
    """A run of 200,000 equal letters, and the same with its last quarter replaced: lanes pass 32,767."""
    run = b"a" * 200_000
    other = lines(4, 1200).encode().replace(b"\n", b" ")[:50_000]
    whole, changed = FP.fingerprint_of([run]), FP.fingerprint_of([run[:150_000] + other])
    assert len(other) == 50_000 and np.abs(whole.sketch.astype(np.int32)).max() > 1 << 16
    assert FP.likeness(whole, changed) > 0.9
    assert FP.Fingerprint.of_text(whole.text()).text() == whole.text()
    assert (changed - FP.fingerprint_of([run[:150_000] + other])).text() == (whole - whole).text()


def test_long_texts_are_hashed_in_pieces_alike(monkeypatch):
    text = [t.encode() for t in lines(3, 30).split("\n")]
    whole = FP.fingerprint_of(text).text()
    monkeypatch.setattr(FP, "PIECE", 100)
    assert FP.fingerprint_of(text).text() == whole


def test_insert_and_delete_on_columns(spark):
    df = FP.fingerprints(spark.createDataFrame([("a\nb",), (None,)], "text string"))
    out = df.select(FP.delete_paragraph(FP.insert_paragraph(F.col("fingerprint"), F.lit("c")), F.lit("a")).alias("f")).collect()
    assert out[0].f == FP.fingerprint_of([b"b", b"c"]).text()
    assert out[1].f == (FP.fingerprint_of([b"", b"c"]) - FP.fingerprint_of([b"a"])).text()


def expected(rows):
    """Each row of (doc_id, text) with the next one, by plain Python; ties may follow in any order."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        fp, of_next = FP.fingerprint_of(text.encode().split(b"\n")), FP.fingerprint_of(following.encode().split(b"\n"))
        changed = FP.fingerprint_of(edited.encode().split(b"\n"))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), sha, fp.text(), changed.text(), FP.likeness(fp, changed), FP.likeness(fp, of_next)))
    return out


def test_next_document_across_ranges(spark):
    rows = [(i * 7 % 101, lines(i, 3 + i % 5)) for i in range(101)]
    got = FP.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected(sorted(rows)))


def test_awkward_rows(spark, awkward, empty):
    got = FP.compare_with_next(awkward).collect()
    tie = {(r.doc_id, r.text): r.tie for r in awkward.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()}
    rows = sorted(((r[0], r[1]) for r in awkward_rows()), key=lambda r: (r[0] is not None, r[0] or 0, tie[r]))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected(rows), key=key)
    assert FP.compare_with_next(empty).count() == 0
    one = FP.compare_with_next(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == expected([(5, "abcdefgh")])
    kept = FP.fingerprints(awkward)
    assert kept.count() == awkward.count() and set(kept.columns) == set(awkward.columns)
