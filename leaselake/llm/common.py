"""What the operators of this folder share: bounded chunks of Arrow rows, folds, global row order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaselake.session import stored

CHUNK_ROWS = 256
CHUNK_BYTES = 4 << 20


def chunks(batch: pa.RecordBatch, column: str, rows: int = CHUNK_ROWS, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows, cut as soon as the texts pass ``size`` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, length in enumerate(lengths):
        if i > start and (i - start >= rows or held + length > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)


def map_chunks(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str | T.StructType,
    column: str = "text",
    rows: int = CHUNK_ROWS,
    size: int = CHUNK_BYTES,
) -> DataFrame:
    """Apply ``function`` to bounded chunks of rows; no shuffle, memory bounded by a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column, rows, size):
                yield function(part)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a chunk; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts of a chunk; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def with_fields(df: DataFrame, fields: str) -> T.StructType:
    """The schema of a table with more fields, given as in DDL; the table's own schema object stays."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def in_fold(key: str, folds: int, fold: int) -> Column:
    """True where crc32 of the key as text leaves ``fold``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def global_rows(df: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """Number all rows from 0 in ``order`` without meeting in one task; also the number of rows.

    Keep ``df`` narrow: it is range-partitioned, sorted and written once to the shared folder. The place
    of a row is its place in its partition plus the rows of earlier partitions, a table with one row per
    shuffle partition. Rows equal in ``order`` are split by their place in the scan.
    """
    place, seen, part, before, n = fresh(df, "place", "seen", "part", "before", "n")
    ordered = (
        df.withColumn(seen, F.monotonically_increasing_id())
        .repartitionByRange(*order, seen)
        .sortWithinPartitions(*order, seen)
        .withColumn(place, F.monotonically_increasing_id())
        .drop(seen)
    )
    rows = stored(ordered, "rows")
    counts = rows.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count("*").alias(n))
    offsets = counts.select(part, (F.sum(n).over(W.orderBy(part)) - F.col(n)).alias(before))
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias(n)).first()[0]
    numbered = rows.join(F.broadcast(offsets), F.shiftright(place, 33) == F.col(part)).withColumn(
        name, F.col(before) + F.col(place).bitwiseAND((1 << 33) - 1)
    )
    return numbered.drop(place, part, before), total


#: Bits of the filter below: 8 MB, whatever it marks.
FILTER_BITS = 1 << 26


def key_bits(rows: DataFrame, *key: str) -> DataFrame:
    """A filter that marks the keys of some rows: at most 2,048 bitmaps of 4 KB, each a row."""
    place = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    return rows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def maybe_marked(df: DataFrame, bits: DataFrame, name: str, *key: str | Column) -> DataFrame:
    """Add ``name``: false for rows whose key is surely not marked; a few others are true as well.

    The filter is broadcast, bounded by FILTER_BITS, so rows need not move to be told apart; it tells fewer apart as
    the marked keys pass the number of bits, and is never wrong about a marked one.
    """
    at, bucket, held = fresh(df, "bit", "bucket", "bits")
    place = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    own = F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(held)))
    joined = df.withColumns({bucket: F.bitmap_bucket_number(place), at: F.bitmap_bit_position(place)}).join(own, bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring(`{held}`, cast(`{at}` div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col(at) % 8).cast("int")).bitwiseAND(1) == 1
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop(at, bucket, held)
