"""pt-BR literals: money, dates, number words, date arithmetic."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaselake.functions.text import strip_ws

MONEY_TYPE = "decimal(18,2)"

# Money and date patterns, month names, number words.
MONEY_LITERAL = r"(\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d+(?:,\d{2})?)"
MONEY_WITH_SYMBOL = r"(?iuU)R\$\s*" + MONEY_LITERAL
NUMERIC_DATE = r"(?U)\b\d{1,2}/\d{1,2}/\d{4}\b"
WRITTEN_DATE = r"(?iuU)\b(\d{1,2})[ºo°]?\s+de\s+([A-Za-zçãéêíóôúÇÃÉÊÍÓÔÚ]+)\s+de\s+(\d{4})\b"
MONTH_YEAR = r"(?U)\b\d{1,2}/\d{4}\b"
MONTHS = {
    "janeiro": 1, "fevereiro": 2, "marco": 3, "março": 3, "abril": 4, "maio": 5, "junho": 6,
    "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
}
NUMBER_WORDS = {
    "zero": 0, "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "três": 3, "quatro": 4,
    "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12,
    "treze": 13, "quatorze": 14, "catorze": 14, "quinze": 15, "dezesseis": 16, "dezessete": 17,
    "dezoito": 18, "dezenove": 19, "vinte": 20, "trinta": 30,
}
COMPOUND_NUMBER = r"(?U)^(vinte|trinta)\s+e\s+([a-zçãêé]+)"


def _lookup(table: dict[str, int], key: Column) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def parse_money(col: Column) -> Column:
    """'1.234,56' to decimal(18,2); anything unreadable is null."""
    plain = F.replace(F.replace(strip_ws(col), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.nullif(plain, F.lit("")).try_cast(MONEY_TYPE)


def find_money(col: Column) -> Column:
    """F8: every 'R$' value of the text, in order."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(MONEY_WITH_SYMBOL), F.lit(1))
    return F.filter(F.transform(found, parse_money), lambda v: v.isNotNull())


def parse_date(col: Column) -> Column:
    """first date, tried as dd/mm/yyyy, then written out, then mm/yyyy (day 1).

    A numeric date that matches but does not exist gives null without trying the
    other forms; an unknown month name goes on to mm/yyyy.
    """
    month = _lookup(MONTHS, F.lower(F.regexp_extract(col, WRITTEN_DATE, 2)))
    day_first = F.coalesce(
        F.regexp_substr(col, F.lit(NUMERIC_DATE)),
        F.concat(
            F.regexp_extract(col, WRITTEN_DATE, 1),
            F.lit("/"),
            month.cast("string"),
            F.lit("/"),
            F.regexp_extract(col, WRITTEN_DATE, 3),
        ),
        F.concat(F.lit("1/"), F.regexp_substr(col, F.lit(MONTH_YEAR))),
    )
    return F.try_to_date(day_first, "d/M/yyyy")


def number_from_words(col: Column) -> Column:
    """number words 0-39 to int; outside that range null."""
    plain = F.lower(strip_ws(col))
    base = _lookup(NUMBER_WORDS, F.nullif(F.regexp_extract(plain, COMPOUND_NUMBER, 1), F.lit("")))
    unit = _lookup(NUMBER_WORDS, F.nullif(F.regexp_extract(plain, COMPOUND_NUMBER, 2), F.lit("")))
    return F.coalesce(_lookup(NUMBER_WORDS, plain), F.when(unit < 10, base + unit))


def round_money(col: Column) -> Column:
    """two decimals, half up."""
    return F.round(col, 2).cast(MONEY_TYPE)


def as_date(ref: date | str | Column) -> Column:
    """An explicit reference date as a column."""
    return ref if isinstance(ref, Column) else F.lit(str(ref)).cast("date")


def next_adjustment(start: Column, period: Column, ref: Column) -> Column:
    """smallest start + k * period on or after ref, k at least 1.

    Months are always added to the original start, so month ends do not drift.
    """
    gap = (F.year(ref) - F.year(start)) * 12 + F.month(ref) - F.month(start)
    k = F.greatest(F.lit(1), F.floor(gap / period).cast("int"))
    first = F.add_months(start, k * period)
    following = F.add_months(start, (k + 1) * period)
    return F.when(period > 0, F.when(first < ref, following).otherwise(first))


def clean_list(col: Column) -> Column:
    """trim items, drop blanks, keep the first of equal items; null becomes []."""
    items = F.transform(
        F.coalesce(col, F.array().cast("array<string>")),
        lambda v: strip_ws(F.coalesce(v, F.lit(""))),
    )
    return F.array_distinct(F.filter(items, lambda v: v != ""))
