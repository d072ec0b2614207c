"""Whole contracts in four layouts, written for this test, against all fields of the matrix."""

from datetime import date
from decimal import Decimal as D

import pytest

from leaselake.plans.contracts import analyse

LABELLED = """CONTRATO DE LOCAÇÃO RESIDENCIAL

LOCADOR: Jonas Prado Lima, brasileiro, casado, CPF nº 123.456.789-09, morador desta cidade.

LOCATÁRIO: Oficina Norte LTDA, inscrita no CNPJ sob o nº 11.222.333/0001-81, com sede nesta cidade.

O imóvel se destina a fins residenciais. O aluguel mensal é de R$ 3.500,00, com vencimento todo dia 5.

A locação tem prazo de 24 meses, com vigência de 01/03/2024 a 28/02/2026.

Como garantia o inquilino presta caução em dinheiro.

O valor será reajustado pelo IGP-M/FGV anualmente, sendo o reajuste automático. Próximo reajuste em 03/2025.

A multa por rescisão antecipada equivale a 3 (três) aluguéis.
"""
NUMBERED = """CONTRATO DE LOCAÇÃO COMERCIAL

LOCADORA: Galpões Sul S.A., CNPJ nº 45.566.778/0001-09.

LOCATÁRIA: Mercado Leste LTDA, CNPJ nº 98.765.432/0001-10.

CLÁUSULA 1. A locação destina-se a fins comerciais, pelo prazo de 60 (sessenta) meses, de 01/01/2025 a 31/12/2029.

CLÁUSULA 2. O aluguel será de R$ 12.000,00, a ser pago até o dia 10 de cada mês.

CLÁUSULA 3. São garantias a caução em dinheiro e a fiança de terceiro.

CLÁUSULA 4. O aluguel será reajustado pelo IPCA a cada 12 meses.

CLÁUSULA 5. A ocupante renuncia a indenização por benfeitorias necessárias.

CLÁUSULA 6. Aplica-se cumulativamente a multa moratória e a penal. Em caso de rescisão a multa será de R$ 24.000,00.
"""
LETTERED = """CONTRATO DE LOCAÇÃO RESIDENCIAL

LOCADOR (A): Casa Clara Imóveis LTDA, CNPJ nº 45.997.418/0001-53.

LOCATÁRIO (A): Rita Nunes Alves, CPF nº 987.654.321-00.

O aluguel é de R$ 1.800,00 e o pagamento se fará todo o dia 20.

O prazo da locação é de vinte e quatro meses, de 15 de julho de 2026 a 14 de julho de 2028.

A garantia é o seguro-fiança contratado em seguradora idônea.

O valor acompanha o salário mínimo, com correção semestral.
"""
BARE = """CONTRATO DE LOCAÇÃO

LOCADOR: Otávio Reis, CPF nº 111.444.777-35.

LOCATÁRIO: Sílvia Campos, CPF nº 222.555.888-42.

O aluguel é de R$ 2.000,00, pago até o dia 8 de cada mês, pelo prazo de 30 meses.

Fica prestada caução em dinheiro, e o valor segue a variação do IPCA.
"""
TEXTS = {"labelled": LABELLED, "numbered": NUMBERED, "lettered": LETTERED, "bare": BARE}
NO_FLAGS = (False,) * 5
# landlord, tenant, type, rent, penalty, guarantees, start, end, term, day, index, period, next, automatic, flags
MATRIX = {
    "labelled": (
        ("PF", "Jonas Prado Lima", "12345678909"), ("PJ", "Oficina Norte LTDA", "11222333000181"), "residencial", D("3500.00"),
        D("10500.00"), ["caucao"], date(2024, 3, 1), date(2026, 2, 28), 24, 5, "IGP-M", 12, date(2025, 3, 1), True, NO_FLAGS,
    ),
    "numbered": (
        ("PJ", "Galpões Sul S.A", "45566778000109"), ("PJ", "Mercado Leste LTDA", "98765432000110"), "comercial", D("12000.00"),
        D("24000.00"), ["caucao", "fianca"], date(2025, 1, 1), date(2029, 12, 31), 60, 10, "IPCA", 12, date(2027, 1, 1), False,
        (True, False, False, True, True),
    ),
    "lettered": (
        ("PJ", "Casa Clara Imóveis LTDA", "45997418000153"), ("PF", "Rita Nunes Alves", "98765432100"), "residencial", D("1800.00"),
        None, ["seguro_fianca"], date(2026, 7, 15), date(2028, 7, 14), 24, 20, "salário mínimo", 6, date(2027, 1, 15), False,
        (False, True, True, False, False),
    ),
    "bare": (
        ("PF", "Otávio Reis", "11144477735"), ("PF", "Sílvia Campos", "22255588842"), None, D("2000.00"),
        None, ["caucao"], None, None, 30, 8, "IPCA", None, None, False, NO_FLAGS,
    ),
}
FIELDS = (
    "landlord", "tenant", "lease_type", "rent", "termination_penalty", "guarantees", "start_date", "end_date", "term_months", "due_day",
    "adjustment_index", "adjustment_period_months", "adjustment_next", "adjustment_automatic", "flags",
)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    return {r.id: r for r in analyse(df, ref_date="2026-10-06").collect()}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("field", range(len(FIELDS)))
def test_field(rows, name, field):
    got = rows[name][FIELDS[field]]
    if FIELDS[field] == "flags":
        got = tuple(got[:5])
    elif hasattr(got, "asDict"):
        got = tuple(got)
    assert got == MATRIX[name][field]
