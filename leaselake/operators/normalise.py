"""Column normalising with reasons and a quality summary (2.2 as one job)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.functions import parsing as P
from leaselake.functions.keys import detect_tax_id, digits_only, normalise_key
from leaselake.functions.text import name_key, null_if_empty, strip_ws


def _with_reason(value: Column, raw: Column, reason: str) -> Column:
    return F.struct(
        value.alias("value"),
        F.when(raw.isNotNull() & value.isNull(), F.lit(reason)).alias("reason"),
    )


KINDS = {
    "key": lambda c: normalise_key(c),
    "integer_key": lambda c: normalise_key(c, integer_input=True),
    "money": lambda c: _with_reason(P.parse_money(c), c, "not a money value"),
    "date": lambda c: _with_reason(P.parse_date(c), c, "no valid date"),
    "number_words": lambda c: _with_reason(P.number_from_words(c), c, "no number from 0 to 39"),
    "tax_id": lambda c: _with_reason(detect_tax_id(c), c, "no tax id"),
    "digits": lambda c: _with_reason(null_if_empty(digits_only(c)), c, "no digits"),
    "name": lambda c: _with_reason(null_if_empty(name_key(c)), c, "blank"),
    "text": lambda c: _with_reason(null_if_empty(strip_ws(c)), c, "blank"),
    "list": lambda c: _with_reason(P.clean_list(c), c, "not a list"),
}


def normalise_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Add ``<col>_value`` and ``<col>_reason`` for every column of ``spec``.

    ``spec`` maps a column to a kind: key, integer_key, money, date, number_words,
    tax_id, digits, name, text or list.
    """
    staged = df.withColumns({f"_n_{c}": KINDS[kind](F.col(c)) for c, kind in spec.items()})
    return staged.select(
        *df.columns,
        *[
            F.col(f"_n_{c}.{part}").alias(f"{c}_{part}")
            for c in spec
            for part in ("value", "reason")
        ],
    )


def quality_summary(normalised: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: valid, invalid and null values, from one pass over the table."""
    counts = normalised.agg(
        *[
            F.struct(
                F.count_if(F.col(f"{c}_value").isNotNull()).alias("valid"),
                F.count_if(F.col(c).isNotNull() & F.col(f"{c}_value").isNull()).alias("invalid"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
            ).alias(c)
            for c in columns
        ]
    )
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), f"{c}.*") for c in columns])).alias("r")
    ).select("r.*")


def top_reasons(normalised: DataFrame, columns: list[str]) -> DataFrame:
    """Rejected values per column and reason; the shape of a value is not its text."""
    reasons = normalised.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.regexp_replace(f"{c}_reason", r"(em|dígitos:) ('.*'|\".*\")\.$", "$1 …")
                        .alias("reason"),
                    )
                    for c in columns
                ]
            )
        ).alias("r")
    ).select("r.*")
    return reasons.where(F.col("reason").isNotNull()).groupBy("column", "reason").agg(
        F.count("*").alias("rows")
    )
