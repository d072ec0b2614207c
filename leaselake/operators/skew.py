"""Joins and group values that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaselake.session import stored

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
HOT_SPREAD = 1024
MAX_BROADCAST_ROWS = 10_000


def bucket(count: int, *cols: str | Column) -> Column:
    """Stable bucket of a row; the same after a retry, unlike a random salt."""
    return F.pmod(F.xxhash64(*cols), F.lit(count)).cast("int")


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a side that was counted; else the planner decides."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _many(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and more than 1/10,000 of all rows: at most 10,000."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("n")).scalar()
    return counts.where(F.col("_rows") > F.greatest(F.lit(hot_rows).cast("double"), total / MAX_HOT_KEYS)).drop("_rows")


def lookup_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join to a side with unique keys, whatever share of ``left`` one key has.

    Keys with many left rows are counted first; their few right rows are broadcast and
    their left rows need not meet. Those rows, and rows with a null key, which match
    nothing, pass the join of all other keys spread by a stable hash.
    """
    values = [c for c in right.columns if c not in on]
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()
    many = _many(left.where(~no_key), on, hot_rows)
    hot = many.join(right.join(F.broadcast(many), on, "left_semi"), on, "left")
    hot = hot.select(*on, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    marked = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | no_key, bucket(HOT_SPREAD, *spread_by) + 1).otherwise(0)
    )
    joined = marked.join(right.withColumn("_salt", F.lit(0)), [*on, "_salt"], "left")
    return joined.select(
        *left.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    )


def attach_group(
    df: DataFrame,
    keys: list[str],
    aggregates: dict[str, Column],
    spread_by: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add aggregates of a row's group to every row, without collecting the group.

    The groups are reduced first (partial sums before the shuffle). Keys with more
    than ``hot_rows`` rows, or more than 1/10,000 of all rows, are at most 10,000;
    their results are broadcast and their rows need no shuffle by key. All other
    keys take a shuffled join.
    """
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("_rows"), *[c.alias(f"_g_{n}") for n, c in aggregates.items()]
    )
    total = grouped.agg(F.sum("_rows").alias("n")).scalar()
    is_hot = F.col("_rows") > F.greatest(F.lit(hot_rows).cast("double"), total / MAX_HOT_KEYS)
    names = [f"_g_{n}" for n in aggregates]
    hot = grouped.where(is_hot).select(
        *keys, F.lit(True).alias("_hot"), *[F.col(n).alias(f"_hot{n}") for n in names]
    )
    cold = grouped.where(~is_hot).select(*keys, F.lit(0).alias("_salt"), *names)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    marked = df.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | no_key, bucket(HOT_SPREAD, *spread_by) + 1).otherwise(0)
    )
    joined = marked.join(cold, [*keys, "_salt"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(F.col(f"_hot_g_{n}"), F.col(f"_g_{n}")).alias(n) for n in aggregates],
    )


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with the number of their range of ``order`` in ``_range``, as many ranges as shuffle partitions.

    Ranges are cut at sampled rows, so they are written down: every later reader sees the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows before each in ``order``, 0 for the first; equal rows of ``order`` by chance.

    Ranges of the order are summed first, their sums are added up over the list of ranges (one row each), and only
    one range is ever ordered in one task.
    """
    rows = in_ranges(df, *order)
    before = lambda window: window.rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(F.sum(value).alias("_sum"))
    carried = sums.select("_range", F.coalesce(F.sum("_sum").over(before(W.orderBy("_range"))), F.lit(0)).alias("_carry"))
    inside = F.coalesce(F.sum(value).over(before(W.partitionBy("_range").orderBy(*order))), F.lit(0))
    return rows.withColumn("_inside", inside).join(F.broadcast(carried), "_range").select(
        *df.columns, (F.col("_carry") + F.col("_inside")).alias(name)
    )


def running_last(
    df: DataFrame, key: str, order: str, value: Column, segment: Column, name: str,
    start: DataFrame | None = None, start_value: str = "",
) -> DataFrame:
    """Last non-null ``value`` before each row of a key, as a two-level scan.

    Rows of one key are cut into segments by ``segment`` (an integer that grows
    with ``order``). Segments are reduced first, their ends are carried forward over
    the short list of segments, and only one segment is ever ordered in one task.
    ``start`` gives keys a value before their first row. Rows move once.
    """
    rows = df.withColumn("_segment", segment).withColumn("_value", value).repartition(key, "_segment")
    ends = rows.groupBy(key, "_segment").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end")
    )
    before = W.partitionBy(key).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
    if start is not None:
        carried = carried.join(start, key, "left").withColumn("_carry", F.coalesce("_carry", start_value))
    inside = F.last("_value", ignorenulls=True).over(
        W.partitionBy(key, "_segment").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_inside", inside)
        .join(carried.select(key, "_segment", "_carry"), [key, "_segment"], "left")
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_segment", "_value", "_inside", "_carry")
    )
