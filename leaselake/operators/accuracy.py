"""Extraction accuracy against known values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy_cells(extracted: DataFrame, truth: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Every (document, field) cell with both values and whether they agree.

    Documents missing on one side give cells that do not agree.
    """
    both = extracted.select(id_col, F.struct(*fields).alias("_got")).join(
        truth.select(id_col, F.struct(*fields).alias("_want")), id_col, "full_outer"
    )
    got = unpivot_struct("_got", fields)
    want = unpivot_struct("_want", fields)
    return both.select(
        id_col,
        (F.col("_got").isNotNull() & F.col("_want").isNotNull()).alias("_both"),
        F.explode(F.arrays_zip(got.alias("got"), want.alias("want"))).alias("e"),
    ).select(
        id_col,
        F.col("e.got.field").alias("field"),
        F.col("e.got.value").alias("got"),
        F.col("e.want.value").alias("want"),
        (F.col("_both") & F.col("e.got.value").eqNullSafe(F.col("e.want.value"))).alias("agrees"),
    )


def unpivot_struct(struct: str, fields: list[str]):
    return F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.when(
                    F.col(f"{struct}.{f}").isNotNull(),
                    F.get_json_object(F.to_json(F.struct(F.col(f"{struct}.{f}").alias("v"))), "$.v"),
                ).alias("value"),
            )
            for f in fields
        ]
    )


def accuracy_matrix(extracted: DataFrame, truth: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Share of agreeing documents per field."""
    return accuracy_cells(extracted, truth, id_col, fields).groupBy("field").agg(
        F.count("*").alias("documents"),
        F.count_if("agrees").alias("agreeing"),
        F.avg(F.col("agrees").cast("double")).alias("accuracy"),
    )
