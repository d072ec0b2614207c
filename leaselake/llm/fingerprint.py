"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line of the text, empty lines included) has a wide vector in two parts: 16 lanes modulo
2^64 from a keyed hash of the whole paragraph, and 256 lanes modulo 2^32 in which each 16-byte window of
the paragraph (one per byte, zero-padded at the start) adds +1 or -1 to one lane. A document's fingerprint
is the sum over its paragraphs, so the order of paragraphs does not matter, and a paragraph is added to or
taken from a fingerprint without the document. The first lanes decide equality; the second ones hold a
sketch in which the distance of two fingerprints estimates how much text differs.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.llm.common import chunks, map_chunks, raw_texts, with_fields

EXACT_LANES = 16
SKETCH_LANES = 256
WINDOW = 16
#: Windows are hashed for so many bytes at a time, so that memory does not follow the longest text.
PIECE = 1 << 20
_PAD = b"\0" * (WINDOW - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Fingerprint:
    """Sums of both parts; modulo arithmetic is the wrap-around of the lane types."""

    __slots__ = ("exact", "sketch")

    def __init__(self, exact: np.ndarray, sketch: np.ndarray):
        self.exact, self.sketch = exact, sketch

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.sketch - other.sketch)

    def text(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    @staticmethod
    def of_text(value: str) -> Fingerprint:
        raw = base64.b64decode(value)
        return Fingerprint(np.frombuffer(raw, "<u8", EXACT_LANES), np.frombuffer(raw, "<u4", SKETCH_LANES, EXACT_LANES * 8))


def _sketch(paragraphs: list[bytes]) -> np.ndarray:
    """Signed counts of all windows of the paragraphs, modulo 2^32."""
    total = np.zeros(SKETCH_LANES, dtype=np.int64)
    joined = _PAD + _PAD.join(paragraphs)
    for start in range(0, len(joined) - WINDOW + 1, PIECE):
        buffer = joined[start : start + PIECE + WINDOW - 1]
        n = len(buffer) - WINDOW + 1
        low = np.ndarray((n,), "<u8", buffer, 0, (1,))
        high = np.ndarray((n,), "<u8", buffer, 8, (1,))
        mixed = (low * _A) ^ (low >> np.uint64(29))
        mixed = (mixed + high) * _B
        mixed ^= mixed >> np.uint64(32)
        mixed *= _A
        # A window that ends in a zero byte ends in padding.
        real = high >> np.uint64(56) != 0
        lane = (mixed >> np.uint64(55)).astype(np.int64)[real]
        counts = np.bincount(lane, minlength=2 * SKETCH_LANES)
        total += counts[:SKETCH_LANES] - counts[SKETCH_LANES:]
    return total.astype(np.uint32)


def fingerprint_of(paragraphs: list[bytes]) -> Fingerprint:
    """Fingerprint of a multiset of paragraphs; none gives zero."""
    digests = []
    for p in paragraphs:
        digests.append(hashlib.blake2b(p, person=b"low").digest())
        digests.append(hashlib.blake2b(p, person=b"high").digest())
    exact = np.frombuffer(b"".join(digests), "<u8").reshape(-1, EXACT_LANES).sum(axis=0, dtype=np.uint64)
    return Fingerprint(exact, _sketch(paragraphs))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """1 for equal fingerprints; else 1 - |a - b|^2 / (|a|^2 + |b|^2) of the sketches, at least 0."""
    if np.array_equal(a.exact, b.exact) and np.array_equal(a.sketch, b.sketch):
        return 1.0
    x, y = (f.sketch.astype(np.int32).astype(np.int64) for f in (a, b))
    d = x - y
    scale = int(x @ x + y @ y)
    return max(0.0, 1 - int(d @ d) / scale) if scale else 0.0


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` to every row; null text counts as empty, i.e. as one empty paragraph.

    A column already named fingerprint is replaced; others are kept. No shuffle.
    """
    kept = docs.drop("fingerprint")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = [fingerprint_of(t.split(b"\n")).text() for t in raw_texts(part, text)]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "fingerprint"])

    return map_chunks(kept, run, with_fields(kept, "fingerprint string"), text)


def _changed(fingerprint: Column, paragraph: Column, sign: int) -> Column:
    @F.pandas_udf("string")
    def change(prints: pd.Series, paragraphs: pd.Series) -> pd.Series:
        out = []
        for old, p in zip(prints, paragraphs):
            if old is None or p is None:
                out.append(old)
                continue
            own, f = fingerprint_of([p.encode()]), Fingerprint.of_text(old)
            out.append((f + own if sign > 0 else f - own).text())
        return pd.Series(out, dtype=object)

    return change(fingerprint, paragraph)


def insert_paragraph(fingerprint: Column, paragraph: Column) -> Column:
    """Fingerprint after adding a paragraph; a null on either side leaves the fingerprint."""
    return _changed(fingerprint, paragraph, 1)


def delete_paragraph(fingerprint: Column, paragraph: Column) -> Column:
    """Fingerprint after removing a paragraph that the document has."""
    return _changed(fingerprint, paragraph, -1)


def _edited(text: str, following: str, own: Fingerprint) -> tuple[str, Fingerprint]:
    """The text with its last quarter replaced, and its fingerprint by deleting and inserting paragraphs."""
    n = len(text)
    k = n // 4
    edited = text[: n - k] + following[:k]
    # Paragraphs that end before the cut are in both texts.
    cut = text.rfind("\n", 0, n - k) + 1
    out, into = text[cut:].encode().split(b"\n"), edited[cut:].encode().split(b"\n")
    return edited, own - fingerprint_of(out) + fingerprint_of(into)


def _record(doc_id: int | None, text: str, following: str, own: Fingerprint, next_own: Fingerprint) -> tuple:
    edited, changed = _edited(text, following, own)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.text(), changed.text(),
        likeness(own, changed), likeness(own, next_own),
    )


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each document, its edited text and the next document by doc_id (after the last: the first).

    Rows are ordered by doc_id (nulls first), then by a hash of the text. The order is cut into ranges at
    keys of real rows, one range per shuffle partition, and these keys are all the driver sees. The first
    row of a range also goes to the range before it, so each range, sorted once, streams past with one row
    held. Texts cross the network once. Repeated rows follow each other; null texts count as empty; one row
    is its own next row; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("doc_id", "tie").repartitionByRange(ranges, "doc_id", "tie")
    firsts = keys.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("doc_id", "tie")).alias("key"))
    starts = sorted((r.key.doc_id is not None, r.key.doc_id or 0, r.key.tie) for r in firsts.collect())
    if not starts:
        return spark.createDataFrame([], _RESULT)
    count = len(starts)

    @F.pandas_udf("array<int>")
    def ranges_of(known: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for key in zip(known.tolist(), ids.tolist(), ties.tolist()):
            at = bisect.bisect_right(starts, key) - 1
            out.append([at, (at - 1) % count] if starts[at] == key else [at])
        return pd.Series(out)

    own_ranges = ranges_of(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("tie"))
    dealt = rows.select("doc_id", "tie", "text", F.posexplode(own_ranges).alias("ahead", "range"))
    # A range of its own for each task; within it the row ahead comes last.
    sorted_rows = dealt.repartitionById(count, F.col("range")).sortWithinPartitions("range", "ahead", "doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in chunks(batch, "text"):
                out = []
                for doc_id, text, ahead, at in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "ahead", "range"))):
                    if held is not None and held[2] and ahead and held[3] == at:
                        continue  # repeats of the row ahead
                    own = fingerprint_of((text or "").encode().split(b"\n"))
                    if held is not None and not held[2]:
                        out.append(_record(held[0], held[1], text or "", held[4], own))
                    held = (doc_id, text or "", ahead, at, own)
                yield _batch(out)

    return sorted_rows.mapInArrow(run, _RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [part.split()[0] for part in _RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
