"""Display labels of the ledger, in pt-BR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaselake.functions.parsing import round_money

# Expense labels in declaration order, payer labels, messages.
EXPENSE_LABELS = (
    ("iptu", "IPTU"),
    ("condominio_ordinario", "Condomínio (ordinário)"),
    ("condominio_extraordinario", "Condomínio (extraordinário)"),
    ("seguro_incendio", "Seguro-incêndio"),
    ("taxa_administracao", "Taxa de administração"),
    ("outras", "Outras"),
)
PAYER_LABELS = (("locador", "Locador"), ("locatario", "Locatário"))
UNKNOWN_PAYER = "não identificado"
UNNAMED_PARTY = "(sem nome identificado)"
PENDING_MESSAGE = "Contrato da Empresa %s / %s não encontrado"


def money_label(col: Column) -> Column:
    """'R$ 1.234,56'; null becomes ''."""
    value = round_money(col)
    grouped = F.translate(F.format_number(F.abs(value), 2), ",.", ".,")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.coalesce(F.concat(sign, F.lit("R$ "), grouped), F.lit(""))


def date_label(col: Column) -> Column:
    """dd/mm/yyyy; null becomes ''."""
    return F.coalesce(F.date_format(col, "dd/MM/yyyy"), F.lit(""))


def yes_no(col: Column) -> Column:
    """F16."""
    return F.when(col, F.lit("Sim")).otherwise(F.lit("Não"))


def _payer_label(payer: Column) -> Column:
    label = F.lit(UNKNOWN_PAYER)
    for code, text in reversed(PAYER_LABELS):
        label = F.when(payer == code, F.lit(text)).otherwise(label)
    return label


def expenses_label(col: Column) -> Column:
    """'label: payer' in declaration order; empty or null map becomes ''."""
    parts = [
        F.when(
            F.map_contains_key(col, F.lit(code)),
            F.concat(F.lit(f"{text}: "), _payer_label(F.try_element_at(col, F.lit(code)))),
        )
        for code, text in EXPENSE_LABELS
    ]
    return F.concat_ws("; ", *parts)


def renewal_label(automatic: Column, months: Column) -> Column:
    """F18."""
    return (
        F.when(~F.coalesce(automatic, F.lit(False)), F.lit("Não"))
        .when(months.isNotNull(), F.concat(F.lit("Sim ("), months.cast("string"), F.lit(" meses)")))
        .otherwise(F.lit("Sim"))
    )


def grace_label(months: Column) -> Column:
    """F19."""
    return F.coalesce(F.concat(months.cast("string"), F.lit(" meses")), F.lit(""))


def extra_landlords_label(parties: Column) -> Column:
    """names joined; a party without a name gets the fallback text."""
    names = F.transform(
        parties, lambda p: F.coalesce(F.nullif(p["name"], F.lit("")), F.lit(UNNAMED_PARTY))
    )
    return F.coalesce(F.array_join(names, "; "), F.lit(""))


def pending_message(name: Column, key: Column) -> Column:
    """F21."""
    return F.format_string(PENDING_MESSAGE, name, key)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def plain_decimal(col: Column) -> Column:
    """Decimal text without trailing zeros after the point ('0.07500' to '0.075')."""
    text = col.cast("string")
    return F.when(
        F.instr(text, ".") > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    ).otherwise(text)


def percent_text(rate: Column) -> Column:
    """Rate as a percentage; whole tens are written in exponent form (10 is '1E+1')."""
    percent = plain_decimal((rate * 100).cast("decimal(12,5)"))
    zeros = F.length(percent) - F.length(F.rtrim(percent, F.lit("0")))
    whole_tens = percent.rlike("^[1-9][0-9]*0+$")
    return F.when(
        whole_tens, F.concat(F.rtrim(percent, F.lit("0")), F.lit("E+"), zeros.cast("string"))
    ).otherwise(percent)


def bracket_label(low: Column, high: Column, rate: Column) -> Column:
    """text of one tax bracket."""
    percent = percent_text(rate)
    return F.when(
        high.isNull(), F.concat(F.lit("acima de "), low.cast("string"), F.lit(" — "), percent, F.lit("%"))
    ).otherwise(
        F.concat(
            F.lit("de "), low.cast("string"), F.lit(" até "), high.cast("string"),
            F.lit(" — "), percent, F.lit("%"),
        )
    )
