"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of three errors or fewer, no two segments
can both have more than one, so some pair of segments has at most one error in each. Each segment is decoded
to the index of its nearest Golay codeword; a segment that lies one bit beside another decodes to an index
among the other's one or six nearby ones. So a fingerprint is filed under one key per pair of segments,
looked up under every combination of nearby indices, and the fingerprints that meet are compared in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm import golay
from leaselake.llm.common import chunks, fresh, key_bits, maybe_marked, raw_texts, with_fields
from leaselake.llm.components import connected_components
from leaselake.operators.skew import broadcast_if_small
from leaselake.session import stored

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Low bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Keys with more fingerprints than this are compared in blocks of this many.
BLOCK = 256


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the lower-cased shingles of ``size`` words in order; a shorter text is one, no word gives none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    return np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")


def fingerprint(raw: bytes) -> int:
    """64-bit SimHash of the lower-cased 3-word shingles of a text; 0 without a word."""
    hashes = shingles(raw)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns and ``fingerprint`` (long, the 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                values = np.array([fingerprint(raw) for raw in raw_texts(part, text)], dtype="<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(values)], [*columns, "fingerprint"])

    schema = with_fields(docs.select(*columns), "fingerprint long")
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def _indices(values: np.ndarray) -> list[np.ndarray]:
    """Nearby indices of each segment, shape (fingerprints, 24); the first of each row is the own one."""
    return [golay.nearby(((values >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int32)) for low, width in SEGMENTS]


def _filed(values: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = [(p << 24) | (own[i][:, 0].astype(np.int64) << 12) | own[j][:, 0] for p, (i, j) in enumerate(PAIRS)]
    return np.concatenate(keys), np.tile(values, len(PAIRS))


def _looked_up(values: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every combination of the distinct nearby indices of both segments of a pair."""
    distinct = []
    for rows in own:
        rows = np.sort(rows, axis=1)
        new = np.ones(rows.shape, dtype=bool)
        new[:, 1:] = rows[:, 1:] != rows[:, :-1]
        distinct.append((rows, new))
    keys, owners = [], []
    for p, (i, j) in enumerate(PAIRS):
        (a, new_a), (b, new_b) = distinct[i], distinct[j]
        row_a, place_a = np.nonzero(new_a)
        count_b = new_b.sum(axis=1)
        first_b = np.cumsum(count_b) - count_b
        flat_b = b[new_b]
        repeats = count_b[row_a]
        owner = np.repeat(row_a, repeats)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        left = np.repeat(a[row_a, place_a], repeats).astype(np.int64)
        keys.append((p << 24) | (left << 12) | flat_b[first_b[owner] + offset])
        owners.append(owner)
    return np.concatenate(keys), values[np.concatenate(owners)]


def _keyed(distinct: DataFrame, function) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(start, 4096).to_numpy(zero_copy_only=False).view("<u8")
                keys, owners = function(values, _indices(values))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners.view("<i8"))], ["key", "fingerprint"])

    return distinct.mapInArrow(run, "key long, fingerprint long")


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def spanning(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, least member) that connect what the links ``near`` between ``a`` and ``b`` connect."""
    rows, columns = np.nonzero(near)
    label_a, label_b = a.copy(), b.copy()
    while True:
        before = (label_a.copy(), label_b.copy())
        np.minimum.at(label_b, columns, label_a[rows])
        np.minimum.at(label_a, rows, label_b[columns])
        if np.array_equal(before[0], label_a) and np.array_equal(before[1], label_b):
            break
    return np.concatenate([a, b]), np.concatenate([label_a, label_b])


def _cell_pairs(key, left: pa.Table, right: pa.Table) -> pa.Table:
    a, b = (np.unique(t.column("fingerprint").to_numpy()) for t in (left, right))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(a), BLOCK):
        part = a[at : at + BLOCK]
        near = np.bitwise_count((part[:, None] ^ b[None, :]).view("<u8")) <= MAX_BITS
        out.append(spanning(part, b, near))
    ends = [np.concatenate(side) if out else np.zeros(0, np.int64) for side in zip(*out)] if out else [np.zeros(0, np.int64)] * 2
    different = ends[0] != ends[1]
    return pa.table({"a": ends[0][different], "b": ends[1][different]})


def connections(distinct: DataFrame) -> DataFrame:
    """Pairs of distinct fingerprints (one long column ``fingerprint``) with the same components as all links.

    Keys with at most BLOCK filed fingerprints give their links by a join. Busier keys are cut into cells
    of about BLOCK filed by BLOCK looked-up fingerprints; a cell compares all of its own and gives a
    spanning forest, so what leaves it grows with its rows and not with their square.
    """
    # A fingerprint becomes some 80 rows: a task gets as many as suits those, not as many as fill a file.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.repartition(tasks, "fingerprint")
    filed, looked_up = _keyed(distinct, _filed), _keyed(distinct, _looked_up)
    busy = stored(
        filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
        "busy-keys",
    )
    hint = broadcast_if_small(busy)
    quiet = looked_up.join(hint, "key", "left_anti").withColumnRenamed("fingerprint", "a").join(
        filed.withColumnRenamed("fingerprint", "b"), "key"
    ).where((F.col("a") != F.col("b")) & _near("a", "b")).select("a", "b")
    if busy.isEmpty():
        return quiet
    # A looked-up fingerprint has up to six times the rows of a filed one in a key.
    spread = F.col("blocks") * 4
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    left = looked_up.join(hint, "key").withColumn("j", F.pmod(F.xxhash64("fingerprint"), spread)).withColumn(
        "cell", F.explode(F.expr("transform(sequence(0, blocks - 1), i -> i * blocks * 4 + j)"))
    )
    right = filed.join(hint, "key").withColumn("i", own).withColumn(
        "cell", F.explode(F.expr("transform(sequence(0, blocks * 4 - 1), j -> i * blocks * 4 + j)"))
    )
    cells = left.select("key", "cell", "fingerprint").groupBy("key", "cell").cogroup(
        right.select("key", "cell", "fingerprint").groupBy("key", "cell")
    ).applyInArrow(_cell_pairs, "a long, b long")
    return quiet.unionByName(cells)


def classes(rows: DataFrame) -> DataFrame:
    """``fingerprint`` and ``root`` (the least fingerprint reachable) for each distinct one that has a link."""
    distinct = stored(rows.select("fingerprint").distinct(), "fingerprints")
    return connected_components(connections(distinct)).select(F.col("node").alias("fingerprint"), "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row.

    Fingerprints of at most MAX_BITS different bits are linked; component_id is the least key reachable.
    Null and empty texts share fingerprint zero, linked like any other. A null key counts as no key: its
    component takes the least other key, or null if there is none. Repeated rows stay repeated.
    """
    rows = stored(fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]), "simhash")
    return with_component(rows).select(
        F.col("doc_id").alias(key),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def with_component(rows: DataFrame) -> DataFrame:
    """Add ``component_id``, the least doc_id of the component, to rows with doc_id and fingerprint.

    Keys are reduced per fingerprint before any join, and the last join has no aggregate above it, so
    adaptive execution can split the fingerprint of a large group of copies.
    """
    linked = classes(rows)
    least = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = least.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = stored(rooted.join(roots, "root").select("fingerprint", "component_id"), "components")
    return rows.join(component, "fingerprint")


def keep_one(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    prints: Callable[[DataFrame, list[str], str], DataFrame] = fingerprints,
    linked: Callable[[DataFrame, DataFrame], DataFrame] = lambda rows, texts: classes(rows),
) -> DataFrame:
    """One document of each component: the one of least (key, text hash), nulls last, with its own columns.

    Of rows repeated in full only one stays. ``prints`` adds ``fingerprint``, equal for texts that count as
    equal, and what else ``linked`` needs to find the classes of fingerprints from these rows and the texts
    (doc_id, tie, text).
    """
    tie, known, unknown, doubtful = fresh(docs, "text_hash", "key_or_zero", "no_key", "doubtful")
    zero = F.lit("0").cast(docs.schema[key].dataType)
    hashed = docs.withColumns({tie: F.xxhash64(text), known: F.coalesce(F.col(key), zero), unknown: F.col(key).isNull()})
    texts = hashed.select(F.col(key).alias("doc_id"), F.col(tie).alias("tie"), F.col(text).alias("text"))
    rows = stored(prints(texts, ["doc_id", "tie"], "text"), "simhash")
    found = linked(rows, texts)
    roots = rows.select("fingerprint").distinct().join(found, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie"))
    # The least row of each fingerprint, then of each component: both reduced before their shuffle.
    kept = (
        rows.groupBy("fingerprint").agg(first.alias("first"))
        .join(roots, "fingerprint").groupBy("root").agg(F.min("first").alias("first"))
        .select(
            F.coalesce(F.col("first.doc_id"), zero).alias(known), F.col("first.unknown").alias(unknown), F.col("first.tie").alias(tie)
        )
    )
    # Rows of a fingerprint of their own without links stay where they are.
    several = rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    others = rows.join(several.unionByName(found.select("fingerprint")).distinct(), "fingerprint")
    told = maybe_marked(hashed, stored(key_bits(others, "doc_id", "tie"), "doubtful-bits"), doubtful, key, tie)
    # Rows repeated in full meet by the same columns as the join, so texts move once.
    same = [known, unknown, tie]
    chosen = told.where(doubtful).join(kept, same).dropDuplicates(same)
    return told.where(~F.col(doubtful)).select(*docs.columns).unionByName(chosen.select(*docs.columns))
