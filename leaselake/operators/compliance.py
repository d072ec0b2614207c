"""Legal-compliance flags and review reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.plans import lease_ptbr as R


def flags_struct(
    guarantees: Column, index: Column, period: Column, waives: Column, cumulates: Column
) -> Column:
    """Five booleans and the alert messages in fixed order."""
    distinct = F.array_distinct(F.coalesce(guarantees, F.array().cast("array<string>")))
    several = F.size(distinct) > 1
    forbidden = F.coalesce(F.lower(index).rlike(R.FORBIDDEN_INDEX_WORDS), F.lit(False))
    short = F.coalesce(period < R.MINIMUM_PERIOD, F.lit(False))
    alerts = F.array_compact(
        F.array(
            F.when(
                several,
                F.format_string(
                    R.ALERT_GUARANTEES, F.size(distinct), F.array_join(F.array_sort(distinct), ", ")
                ),
            ),
            F.when(forbidden, F.format_string(R.ALERT_INDEX, index)),
            F.when(short, F.format_string(R.ALERT_PERIOD, period)),
            F.when(waives, F.lit(R.ALERT_WAIVER)),
            F.when(cumulates, F.lit(R.ALERT_PENALTIES)),
        )
    )
    return F.struct(
        several.alias("several_guarantees"),
        forbidden.alias("forbidden_index"),
        short.alias("short_period"),
        F.coalesce(waives, F.lit(False)).alias("waives_improvements"),
        F.coalesce(cumulates, F.lit(False)).alias("cumulates_penalties"),
        alerts.alias("alerts"),
    )


def compliance_flags(df: DataFrame) -> DataFrame:
    """Add the `flags` struct to the output of ``extract_fields``."""
    return df.withColumn(
        "flags",
        flags_struct(
            F.col("guarantees.value"),
            F.col("adjustment_index.value"),
            F.col("adjustment_period_months.value"),
            F.col("waives_improvements"),
            F.col("cumulates_penalties"),
        ),
    ).drop("waives_improvements", "cumulates_penalties")


def text_clauses(fold: Column) -> dict[str, Column]:
    """The two clause tests on folded text."""
    return {
        "waives_improvements": fold.rlike(R.IMPROVEMENTS_WAIVER),
        "cumulates_penalties": fold.rlike(R.CUMULATIVE_PENALTIES),
    }


def incomplete(rent: Column, tax: Column) -> Column:
    """Rent or tax is missing."""
    return rent.isNull() | tax.isNull()


def review_reason(incomplete_row: Column, review_fields: Column) -> Column:
    """Text of both causes, '' when the row needs no review."""
    return F.concat_ws(
        "; ",
        F.when(incomplete_row, F.lit(R.REASON_INCOMPLETE)),
        F.when(
            F.size(review_fields) > 0,
            F.concat(F.lit(R.REASON_LOW_CONFIDENCE), F.array_join(review_fields, ", ")),
        ),
    )


def triage(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A8: 'scanned' (too short), 'contract' (party structure) or 'other'."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(
        "triage",
        F.when(F.length(text) < R.TRIAGE_MIN_CHARS, F.lit("scanned"))
        .when(F.lower(text).rlike(R.PARTY_STRUCTURE), F.lit("contract"))
        .otherwise(F.lit("other")),
    )
