"""Column functions against literal cases."""

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from leaselake.functions import keys as K
from leaselake.functions import labels as L
from leaselake.functions import parsing as P
from leaselake.functions import text as X


def test_keys(one):
    values = ["11.222.333/0001-81", "  11222333000181  ", "11 222 333 0001 81", "222333000181", "abc", "", None]
    got = one(K.normalise_key, values)
    assert [g.value for g in got] == ["11222333000181"] * 3 + [None] * 4
    assert got[3].reason == "CNPJ deve ter 14 dígitos; obtido 12 em '222333000181'."
    assert got[4].reason == "CNPJ sem dígitos: 'abc'."
    assert got[6].reason == "CNPJ ausente (None)."
    assert one(lambda c: K.key_value(c, True), [222333000181, 11222333000181], "long") == [
        "00222333000181", "11222333000181",
    ]
    assert one(K.check_digits, ["112223330001", "123"]) == ["81", None]
    assert one(
        K.valid_check_digits,
        ["11222333000181", "11.222.333/0001-81", "11222333000180", "11111111111111", "00000000000000", "123"],
    ) == [True, True, False, False, False, False]


def test_tax_ids(one):
    got = one(
        K.detect_tax_id,
        ["CPF 123.456.789-09", "CPF 12345678909", "inscrita no CNPJ 45.566.778/0001-09", "CNPJ 12345678000190", "nada"],
    )
    assert [tuple(g) if g else None for g in got] == [
        ("PF", "12345678909"), ("PF", "12345678909"), ("PJ", "45566778000109"), ("PJ", "12345678000190"), None,
    ]


def test_money(one):
    assert one(P.parse_money, ["1.234,56", "6.000,00", "600,00", "6000", "1.234.567,89", "", "abc", None]) == [
        D("1234.56"), D("6000.00"), D("600.00"), D("6000.00"), D("1234567.89"), None, None, None,
    ]
    assert one(P.find_money, ["aluguel de R$ 3.500,00 e multa de R$ 10.500,00 e taxa R$ 50", "sem dinheiro"]) == [
        [D("3500.00"), D("10500.00"), D("50.00")], [],
    ]
    assert one(L.money_label, [D("5000.00"), D("1234567.89"), D("0.00"), D("-1500.50"), None], "decimal(18,2)") == [
        "R$ 5.000,00", "R$ 1.234.567,89", "R$ 0,00", "-R$ 1.500,50", "",
    ]


def test_dates(one):
    texts = [
        "início em 01/03/2024", "vigência 03/2024", "1º de março de 2024", "15 de dezembro de 2025",
        "de 01/03/2024 a 05/2024", "31/02/2024", "31/02/2024 e 03/2024", "5 de brumário de 2024, 04/2024",
        "31 de fevereiro de 2024 e 03/2024", "sem data", "",
    ]
    assert one(P.parse_date, texts) == [
        date(2024, 3, 1), date(2024, 3, 1), date(2024, 3, 1), date(2025, 12, 15), date(2024, 3, 1),
        None, None, date(2024, 4, 1), None, None, None,
    ]


def test_number_words(one):
    assert one(P.number_from_words, ["doze", "trinta", "Vinte e quatro", "trinta e um", "cento e vinte", "", "vinte e dez"]) == [
        12, 30, 24, 31, None, None, None,
    ]


def test_next_adjustment(spark):
    cases = [
        ("2024-03-01", 12, "2026-10-06", "2027-03-01"), ("2027-01-15", 12, "2026-10-06", "2028-01-15"),
        ("2024-03-01", 12, "2026-03-01", "2026-03-01"), ("2024-03-01", 12, "2026-03-02", "2027-03-01"),
        ("2024-02-29", 12, "2026-10-06", "2027-02-28"), ("2024-02-29", 12, "2027-10-01", "2028-02-29"),
        ("2024-03-01", 6, "2026-10-06", "2027-03-01"), ("2024-01-31", 1, "2024-03-15", "2024-03-31"),
        ("2010-05-10", 12, "2026-10-06", "2027-05-10"), ("2024-03-01", 0, "2026-10-06", None),
        ("2024-03-01", -12, "2026-10-06", None),
    ]
    df = spark.createDataFrame(cases, "s string, p int, r string, want string")
    got = df.select(
        P.next_adjustment(F.col("s").cast("date"), F.col("p"), F.col("r").cast("date")).cast("string").alias("g"), "want"
    ).collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_text(one):
    assert one(X.header_key, ["  Nº do CNPJ ", "RAZÃO SOCIAL", None]) == ["no do cnpj", "razao social", ""]
    assert one(X.name_key, ["  João   da\tSILVA "]) == ["joão da silva"]
    folded = one(X.fold_case, ["İAÇÃO ſ K 😀x"])[0]
    assert folded == "iação s k �x"
    assert one(P.clean_list, [[" a ", "", None, "b", "a"]], "array<string>") == [["a", "b"]]


def test_labels(one):
    assert one(
        L.expenses_label, [{"outras": "locador", "iptu": "locatario"}, {"iptu": None}, {}, None], "map<string,string>"
    ) == ["IPTU: Locatário; Outras: Locador", "IPTU: não identificado", "", ""]
    assert one(L.date_label, [date(2028, 10, 10), None], "date") == ["10/10/2028", ""]
    assert one(L.grace_label, [2, None], "int") == ["2 meses", ""]
    assert one(lambda c: L.renewal_label(c == 1, F.lit(12)), [1, 0], "int") == ["Sim (12 meses)", "Não"]
    assert one(lambda c: L.renewal_label(c == 1, F.lit(None).cast("int")), [1], "int") == ["Sim"]
