"""Progressive brackets and withholding tax.

A bracket table has one row per bracket. For a lookup it becomes one row per
version holding the sorted brackets, so rents join to it by version (an equi-join
with one match per row) and the bracket is picked inside the row.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaselake.functions.labels import bracket_label, plain_decimal
from leaselake.functions.parsing import MONEY_TYPE, round_money
from leaselake.operators.skew import broadcast_if_small, in_ranges, lookup_join
from leaselake.plans import tax_tables as T

BRACKET = "struct<lo:decimal(18,2),hi:decimal(18,2),rate:decimal(6,5),deduction:decimal(18,2)>"
BRACKET_COLUMNS = (
    "version string, lo decimal(18,2), hi decimal(18,2), rate decimal(6,5), "
    "deduction decimal(18,2), legal_basis string, source_url string, validated boolean, "
    "validated_on date"
)


def money(text: str) -> Column:
    return F.lit(text).cast(MONEY_TYPE)


def _sql(value: str | None, type_: str) -> str:
    return f"CAST({'NULL' if value is None else repr(value)} AS {type_})"


def brackets_2026(spark: SparkSession) -> DataFrame:
    """T5: the 2026 reference table, one row per bracket."""
    rows = ", ".join(
        "({}, {}, {}, {})".format(
            _sql(lo, MONEY_TYPE), _sql(hi, MONEY_TYPE), _sql(rate, "decimal(6,5)"), _sql(ded, MONEY_TYPE)
        )
        for lo, hi, rate, ded in T.BRACKETS_2026
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(lo, hi, rate, deduction)").select(
        F.lit(T.VERSION_2026).alias("version"),
        "lo", "hi", "rate", "deduction",
        F.lit(T.LEGAL_BASIS_2026).alias("legal_basis"),
        F.lit(T.SOURCE_URL_2026).alias("source_url"),
        F.lit(True).alias("validated"),
        F.lit(T.VALIDATED_ON_2026).cast("date").alias("validated_on"),
    )


def latest_version(brackets: DataFrame) -> DataFrame:
    """Brackets of the lexicographically greatest version."""
    newest = brackets.agg(F.max("version").alias("v"))
    return brackets.where(F.col("version") == newest.scalar())


def validate_brackets(brackets: DataFrame) -> DataFrame:
    """One row per broken rule and version; no rows means a good table."""
    ordered = W.partitionBy("version").orderBy("lo")
    rows = brackets.withColumn("_next", F.lead("lo").over(ordered))
    is_last = F.col("_next").isNull()
    violation = F.when(is_last & F.col("hi").isNotNull(), F.lit(T.LAST_MUST_BE_OPEN)).when(
        ~is_last & F.col("hi").isNull(), F.lit(T.ONLY_LAST_OPEN)
    )
    return (
        rows.select("version", "lo", "hi", violation.alias("violation"))
        .where(F.col("violation").isNotNull())
    )


def bracket_arrays(brackets: DataFrame) -> DataFrame:
    """One row per version: the brackets sorted by lower bound, and provenance."""
    return brackets.groupBy("version").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "rate", "deduction"))).alias("_brackets"),
        F.first("legal_basis").alias("_legal_basis"),
        F.first("source_url").alias("_source_url"),
    )


def pick_bracket(base: Column, brackets: Column) -> Column:
    """First bracket whose inclusive upper bound covers the base."""
    covering = F.filter(brackets, lambda b: b["hi"].isNull() | (base <= b["hi"]))
    return F.when(base >= 0, F.get(covering, F.lit(0)))


def _with_tables(df: DataFrame, brackets: DataFrame, version_col: str | None) -> DataFrame:
    """Attach the bracket array of each row's version (or of the latest version)."""
    if version_col is None:
        arrays = bracket_arrays(latest_version(brackets)).withColumnRenamed("version", "_version")
        wanted = brackets.agg(F.max("version").alias("v")).scalar()
        keyed = df.withColumn("_version", wanted)
    else:
        arrays = bracket_arrays(brackets).withColumnRenamed("version", "_version")
        keyed = df.withColumn("_version", F.col(version_col))
    return keyed.join(broadcast_if_small(arrays), "_version", "left")


def bracket_join(
    df: DataFrame, base_col: str, brackets: DataFrame, version_col: str | None = None
) -> DataFrame:
    """Add the bracket of ``base_col``; a negative base gets a reason instead."""
    joined = _with_tables(df, brackets, version_col)
    picked = joined.withColumn("_b", pick_bracket(F.col(base_col).cast(MONEY_TYPE), F.col("_brackets")))
    return _found(picked, df.columns, base_col)


def _found(picked: DataFrame, columns: list[str], base_col: str) -> DataFrame:
    """The columns of a lookup from the picked bracket ``_b``."""
    return picked.select(
        *columns,
        F.col("_version").alias("version"),
        F.col("_b.lo").alias("lo"),
        F.col("_b.hi").alias("hi"),
        F.col("_b.rate").alias("rate"),
        F.col("_b.deduction").alias("deduction"),
        bracket_label(F.col("_b.lo"), F.col("_b.hi"), F.col("_b.rate")).alias("bracket"),
        F.when(F.col(base_col) < 0, F.lit(T.NEGATIVE_BASE)).alias("reason"),
    )


def bracket_range_join(
    df: DataFrame, base_col: str, brackets: DataFrame, version_col: str, spread_by: list[str]
) -> DataFrame:
    """T1 for bracket tables of any size: the rows of ``bracket_join``, without a version gathered anywhere.

    The bracket of a base is the least, by lower bound, of those of its version whose upper bound is not below it. So
    the brackets and the distinct bases are laid out in one order, by version and falling bound, where all of
    these come before the base, and each base takes the least bracket so far. The order is cut into ranges; the
    least bracket of a version in each range is carried on over the short list of ranges, and one range is
    one task, whatever share of the brackets a version has. Rows of ``df`` move once, to
    the bracket of their base; ``spread_by`` names columns that tell rows of one base apart (``lookup_join``).

    Null versions and null or negative bases have no bracket. Column names of ``df`` do not begin with ``_``.
    """
    value = F.col(base_col).cast(MONEY_TYPE)
    keyed = df.withColumn("_version", F.col(version_col).cast("string")).withColumn("_value", F.when(value >= 0, value))
    no_bracket = F.lit(None).cast(BRACKET).alias("_bracket")
    bases = keyed.where("_version IS NOT NULL AND _value IS NOT NULL").select("_version", "_value").distinct().select(
        "_version", F.lit(False).alias("_open"), "_value", F.lit(True).alias("_base"), no_bracket
    )
    bounds = brackets.where(F.col("version").isNotNull()).select(
        F.col("version").cast("string").alias("_version"), F.col("hi").isNull().alias("_open"),
        F.col("hi").cast(MONEY_TYPE).alias("_value"), F.lit(False).alias("_base"),
        F.struct("lo", "hi", "rate", "deduction").cast(BRACKET).alias("_bracket"),
    )
    # Open brackets cover every base, so they come first; bounds come before the base of their value.
    order = [F.desc("_open"), F.desc("_value"), F.col("_base"), F.col("_bracket")]
    laid = in_ranges(bases.unionByName(bounds), F.col("_version"), *order)
    ends = laid.groupBy("_version", "_range").agg(F.min("_bracket").alias("_end"))  # at most versions + ranges
    earlier = W.partitionBy("_version").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.min("_end").over(earlier)).where("_carry IS NOT NULL").drop("_end")
    inside = W.partitionBy("_version", "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = laid.withColumn("_here", F.min("_bracket").over(inside)).where("_base")
    found = here.join(broadcast_if_small(carried), ["_version", "_range"], "left").select(
        "_version", "_value", F.least("_here", "_carry").alias("_b")
    )
    return _found(lookup_join(keyed, found, ["_version", "_value"], spread_by), df.columns, base_col)


def reduction(gross: Column) -> Column:
    """T4: reducer on the gross amount; flat, then falling, then none."""
    falling = round_money(
        F.greatest(money("0.00"), money(T.REDUCTION_CONSTANT) - F.lit(T.REDUCTION_FACTOR).cast("decimal(7,6)") * gross)
    )
    return (
        F.when(gross <= money(T.FULL_REDUCTION_CEILING), money(T.FULL_REDUCTION))
        .when(gross <= money(T.REDUCTION_CEILING), falling)
        .otherwise(money("0.00"))
    )


def _note(tax: dict[str, Column]) -> Column:
    """how the tax was found, in one of three wordings."""
    text = {name: column.cast("string") for name, column in tax.items()}
    rate = plain_decimal(tax["rate"])
    prefix = F.format_string(T.NOTE_PREFIX, text["gross"], F.lit(T.SIMPLIFIED_DISCOUNT), text["base"])
    return (
        F.when(tax["rate"] == 0, F.format_string(T.NOTE_EXEMPT, prefix))
        .when(
            tax["reduced"] > 0,
            F.format_string(
                T.NOTE_REDUCED, prefix, text["base"], rate, text["deduction"], text["before"],
                text["reduced"], text["tax"],
            ),
        )
        .otherwise(
            F.format_string(T.NOTE_PLAIN, prefix, text["base"], rate, text["deduction"], text["tax"])
        )
    )


def withholding_tax(
    df: DataFrame,
    rent_col: str,
    landlord_type_col: str,
    brackets: DataFrame,
    version_col: str | None = None,
    out: str = "tax",
) -> DataFrame:
    """Add the tax struct with its full calculation record.

    The struct is null when the rent or the landlord type is missing, or the rent
    is negative (``<out>_reason`` says so). Only the landlord type decides: a
    company landlord has no tax; for a person the tenant's type plays no part.
    """
    staged = _with_tables(df, brackets, version_col).withColumn(
        "_gross", round_money(F.col(rent_col).cast(MONEY_TYPE))
    )
    zero = money("0.00")
    staged = staged.withColumn(
        "_base", round_money(F.greatest(zero, F.col("_gross") - money(T.SIMPLIFIED_DISCOUNT)))
    )
    staged = staged.withColumn("_b", pick_bracket(F.col("_base"), F.col("_brackets")))
    staged = staged.withColumn(
        "_before",
        round_money(F.greatest(zero, F.col("_base") * F.col("_b.rate") - F.col("_b.deduction"))),
    )
    staged = staged.withColumn(
        "_tax", round_money(F.greatest(zero, F.col("_before") - reduction(F.col("_gross"))))
    )
    staged = staged.withColumn("_reduced", (F.col("_before") - F.col("_tax")).cast(MONEY_TYPE))
    company, person = F.col(landlord_type_col) == "PJ", F.col(landlord_type_col) == "PF"
    rate_type = "decimal(6,5)"

    def split(person_value: Column, company_value: Column, type_: str, name: str) -> Column:
        return F.when(company, company_value).otherwise(person_value).cast(type_).alias(name)

    note = _note(
        {
            "gross": F.col("_gross"), "base": F.col("_base"), "rate": F.col("_b.rate"),
            "deduction": F.col("_b.deduction"), "before": F.col("_before"),
            "reduced": F.col("_reduced"), "tax": F.col("_tax"),
        }
    )
    record = F.struct(
        split(F.col("_tax") > 0, F.lit(False), "boolean", "withheld"),
        split(F.col("_tax"), zero, MONEY_TYPE, "amount"),
        split(F.col("_base"), F.col("_gross"), MONEY_TYPE, "base"),
        split(F.col("_b.rate"), F.lit(0), rate_type, "rate"),
        split(F.col("_b.deduction"), zero, MONEY_TYPE, "deduction"),
        split(
            bracket_label(F.col("_b.lo"), F.col("_b.hi"), F.col("_b.rate")),
            F.lit(T.COMPANY_LANDLORD_BRACKET), "string", "bracket",
        ),
        F.col("_version").alias("version"),
        F.col("_legal_basis").alias("legal_basis"),
        F.col("_source_url").alias("source_url"),
        split(note, F.lit(T.COMPANY_LANDLORD_NOTE), "string", "note"),
        split(F.col("_before"), zero, MONEY_TYPE, "before_reduction"),
        split(F.col("_reduced"), zero, MONEY_TYPE, "reduction"),
        F.col("_gross").alias("gross"),
        split(money(T.SIMPLIFIED_DISCOUNT), zero, MONEY_TYPE, "simplified_discount"),
    )
    known = F.col("_gross").isNotNull() & (F.col("_gross") >= 0) & (company | person)
    return staged.select(
        *df.columns,
        F.when(known, record).alias(out),
        F.when(F.col("_gross") < 0, F.lit(T.NEGATIVE_BASE)).alias(f"{out}_reason"),
    )
