"""Tax identifiers: normalising, check digits, detection in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaselake.functions.text import strip_ws

# Official weights of the two check digits, and identifier masks.
KEY_LENGTH = 14
BASE_LENGTH = 12
WEIGHTS_FIRST = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
WEIGHTS_SECOND = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
COMPANY_PATTERN = r"(?U)(?=\d)(?:\b\d{2}\.?\d{3}\.?\d{3}/\d{4}-?\d{2}\b|\b\d{14}\b)"
PERSON_PATTERN = r"(?U)(?=\d)\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"

KEY_RESULT = "struct<value:string,reason:string>"


def digits_only(col: Column) -> Column:
    """drop every non-digit; null becomes ''."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\D", "")


def _quoted(col: Column) -> Column:
    quote = F.when(F.instr(col, "'") > 0, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(quote, col, quote)


def normalise_key(col: Column, integer_input: bool = False) -> Column:
    """struct(value, reason) for a 14-digit key.

    Integer columns lose leading zeros, so they are padded; text keeps what it
    has, so a short text is invalid.
    """
    raw = strip_ws(col.cast("string"))
    digits = digits_only(raw)
    if integer_input:
        digits = F.when(
            (F.length(digits) > 0) & (F.length(digits) < KEY_LENGTH),
            F.lpad(digits, KEY_LENGTH, "0"),
        ).otherwise(digits)
    reason = (
        F.when(col.isNull(), F.lit("CNPJ ausente (None)."))
        .when(F.length(digits) == 0, F.concat(F.lit("CNPJ sem dígitos: "), _quoted(raw), F.lit(".")))
        .when(
            F.length(digits) != KEY_LENGTH,
            F.concat(
                F.lit(f"CNPJ deve ter {KEY_LENGTH} dígitos; obtido "),
                F.length(digits).cast("string"),
                F.lit(" em "),
                _quoted(raw),
                F.lit("."),
            ),
        )
    )
    value = F.when(col.isNotNull() & (F.length(digits) == KEY_LENGTH), digits)
    return F.struct(value.alias("value"), reason.alias("reason"))


def key_value(col: Column, integer_input: bool = False) -> Column:
    """The usable 14-digit key, or null."""
    return normalise_key(col, integer_input)["value"]


def looks_like_key(col: Column, integer_input: bool = False) -> Column:
    """does the value normalise to a 14-digit key?"""
    return key_value(col, integer_input).isNotNull()


def _weighted_sum(digits: Column, weights: tuple[int, ...]) -> Column:
    values = F.transform(F.split(digits, ""), lambda d: F.ascii(d) - F.lit(48))
    products = F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w)
    return F.aggregate(products, F.lit(0), lambda total, p: total + p)


def _mod11_digit(total: Column) -> Column:
    rest = total % F.lit(11)
    return F.when(rest < 2, F.lit(0)).otherwise(F.lit(11) - rest)


def check_digits(col: Column) -> Column:
    """the two check digits of a 12-digit base; null when it has not 12 digits.

    The second digit weighs the base and the first digit, whose weight is the last.
    """
    base = digits_only(col)
    usable = F.when(F.length(base) == BASE_LENGTH, base)
    sums = F.array(
        F.struct(
            _weighted_sum(usable, WEIGHTS_FIRST).alias("a"),
            _weighted_sum(usable, WEIGHTS_SECOND[:BASE_LENGTH]).alias("b"),
        )
    )
    digits = F.transform(sums, lambda s: F.struct(_mod11_digit(s["a"]).alias("a"), s["b"].alias("b")))
    both = F.transform(
        digits,
        lambda s: F.concat(
            s["a"].cast("string"), _mod11_digit(s["b"] + s["a"] * WEIGHTS_SECOND[-1]).cast("string")
        ),
    )
    return F.get(both, F.lit(0))


def valid_check_digits(col: Column, integer_input: bool = False) -> Column:
    """strict check; keys of one repeated digit are rejected."""
    key = key_value(col, integer_input)
    repeated = key == F.repeat(F.substring(key, 1, 1), KEY_LENGTH)
    good = F.substring(key, 13, 2) == check_digits(F.substring(key, 1, BASE_LENGTH))
    return F.coalesce(~repeated & good, F.lit(False))


def detect_tax_id(col: Column) -> Column:
    """first company identifier, else first person identifier; null if none."""
    company = F.regexp_substr(col, F.lit(COMPANY_PATTERN))
    person = F.regexp_substr(col, F.lit(PERSON_PATTERN))
    return F.when(
        company.isNotNull(), F.struct(F.lit("PJ").alias("type"), digits_only(company).alias("document"))
    ).when(person.isNotNull(), F.struct(F.lit("PF").alias("type"), digits_only(person).alias("document")))
