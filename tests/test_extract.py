"""Extraction rules on short texts, and the compliance flags."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from leaselake.operators import extract as E
from leaselake.operators.compliance import compliance_flags, flags_struct, triage

BLOCKS = (
    "LOCADOR: FULANO DE TAL, brasileiro, CPF nº 111.111.111-11.\n\n"
    "LOCADOR: BELTRANA DA SILVA, brasileira, CPF nº 222.222.222-22.\n\n"
    "LOCADOR: BELTRANA DA SILVA, brasileira, CPF nº 222.222.222-22.\n\n"
    "LOCATÁRIO: EMPRESA EXEMPLO LTDA, CNPJ nº 12.345.678/0001-99.\n\n"
)
PROSE = (
    "de um lado, como LOCADORA e aqui doravante assim denominada, ALFA LOGISTICA LTDA, inscrita no CNPJ sob "
    "nº 22.333.444/0001-81, e do outro, como LOCATÁRIO a sociedade empresária BETA CONSTRUTORA LTDA, inscrita "
    "no CNPJ sob o nº 33.555.666/0001-65, mediante cláusulas."
)
# text, field, expected value, expected confidence
CASES = [
    ("LOCADORA: Beta Empreendimentos LTDA\n\n", "landlord", ("PJ", "Beta Empreendimentos LTDA", None), 0.7),
    ("LOCADORA: ________________________\n\n", "landlord", None, 0.0),
    ("LOCATÁRIA (O/S): Maria Exemplo, CPF 222.555.888-42\n\n", "tenant", ("PF", "Maria Exemplo", "22255588842"), 0.9),
    (PROSE, "landlord", ("PJ", "ALFA LOGISTICA LTDA", "22333444000181"), 0.7),
    (PROSE, "tenant", ("PJ", "BETA CONSTRUTORA LTDA", "33555666000165"), 0.7),
    (PROSE + "\n\nLOCADORA: ______\n\nLOCATÁRIO: ______", "landlord", ("PJ", "ALFA LOGISTICA LTDA", "22333444000181"), 0.7),
    (BLOCKS, "extra_landlords", [("PF", "BELTRANA DA SILVA", "22222222222")], 0.9),
    ("sem partes", "extra_landlords", [], 0.9),
    ("destina-se a fins residenciais", "lease_type", "residencial", 0.9),
    ("para atividade empresarial", "lease_type", "comercial", 0.9),
    ("uso residencial e também comercial", "lease_type", None, 0.0),
    ("CONTRATO DE LOCAÇÃO RESIDENCIAL\na sala comercial 12", "lease_type", "residencial", 0.9),
    ("CONTRATO DE LOCAÇÃO NÃO RESIDENCIAL", "lease_type", "residencial", 0.9),
    ("O aluguel mensal importa em R$ 1.800,00.", "rent", D("1800.00"), 0.9),
    ("O preço mensal da locação é de R$ 7.800,00, taxa de R$ 2.325,00", "rent", D("7800.00"), 0.9),
    ("contrato sem valor", "rent", None, 0.0),
    ("multa rescisória de R$ 5.000,00", "termination_penalty", D("5000.00"), 0.9),
    ("aluguel de R$ 1.000,00.\nmulta equivalente a 3 (três) aluguéis", "termination_penalty", D("3000.00"), 0.7),
    ("multa de 3 aluguéis", "termination_penalty", None, 0.0),
    ("garantia: seguro-fiança locatícia", "guarantees", ["seguro_fianca"], 0.9),
    ("caução em dinheiro e fiança de fiador idôneo", "guarantees", ["caucao", "fianca"], 0.9),
    ("mediante cessão fiduciária de quotas", "guarantees", ["cessao_fiduciaria"], 0.9),
    ("com vigência de 01/03/2024 a 28/02/2026", "start_date", date(2024, 3, 1), 0.9),
    ("com vigência de 01/03/2024 a 28/02/2026", "end_date", date(2026, 2, 28), 0.9),
    ("iniciando-se em 30 de julho de 2026 e encerrando-se", "start_date", date(2026, 7, 30), 0.7),
    ("término em 14/07/2028", "end_date", date(2028, 7, 14), 0.7),
    ("pelo prazo de 24 (vinte e quatro) meses", "term_months", 24, 0.9),
    ("prazo de vinte e quatro meses.\ncorreção a cada 6 meses", "term_months", 24, 0.7),
    ("prazo determinado de 05 (cinco) anos", "term_months", 60, 0.9),
    ("pelo prazo de cinco anos", "term_months", 60, 0.7),
    ("locação pactuada por 12 meses", "term_months", 12, 0.45),
    ("pagamento até o dia 5 de cada mês", "due_day", 5, 0.9),
    ("todo o dia 20", "due_day", 20, 0.9),
    ("dia 40 de cada mês", "due_day", None, 0.0),
    ("haverá carência de 2 (dois) meses", "grace_months", 2, 0.9),
    ("prazo de 24 meses", "grace_months", None, 0.9),
    ("haverá carência de 60 dias", "grace_months", None, 0.0),
    ("pelo IPCA ou pelo IGP-M", "adjustment_index", "IGP-M", 0.9),
    ("reajuste pelo salário mínimo", "adjustment_index", "salário mínimo", 0.9),
    ("variação cambial do dólar", "adjustment_index", "moeda estrangeira", 0.9),
    ("reajustado pelo IGP-M/FGV anualmente", "index_source", "FGV", 0.9),
    ("reajustado pelo IGP-M anualmente", "index_source", None, 0.9),
    ("reajustado anualmente", "adjustment_period_months", 12, 0.9),
    ("correção semestral", "adjustment_period_months", 6, 0.9),
    ("reajuste automático", "adjustment_automatic", True, 0.9),
    ("será corrigido", "adjustment_automatic", False, 0.45),
    ("próximo reajuste em 03/2025", "adjustment_next", date(2025, 3, 1), 0.7),
    ("O locatário pagará o IPTU incidente.", "expenses", {"iptu": "locatario"}, 0.9),
    (
        "As despesas ordinárias de condomínio ficam a cargo do locatário, enquanto as despesas extraordinárias "
        "de condomínio serão de responsabilidade do locador.",
        "expenses", {"condominio_ordinario": "locatario", "condominio_extraordinario": "locador"}, 0.9,
    ),
    ("O IPTU incidente sobre o imóvel, referente ao exercício", "expenses", {"iptu": None}, 0.9),
    ("sem despesas", "expenses", None, 0.0),
    ("será prorrogado automaticamente por igual período de 12 (doze) meses", "renewal_months", 12, 0.9),
    ("prorrogar-se-á por prazo indeterminado", "renewal_automatic", True, 0.9),
    ("", "rent", None, 0.0),
]


def plain(value):
    if hasattr(value, "asDict"):
        return tuple(value)
    return [plain(v) for v in value] if isinstance(value, list) else value


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    return {r.i: r for r in E.extract_fields(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(results, i):
    _, field, value, confidence = CASES[i]
    got = results[i][field]
    assert plain(got.value) == value
    assert got.confidence == confidence


def test_calculated_date_and_provenance(spark):
    from leaselake.plans.contracts import analyse

    texts = [
        ("annual", "O prazo tem início em 01/03/2024.\naluguel de R$ 2.000,00, reajustado pelo IGP-M anualmente."),
        ("explicit", "início em 01/03/2024.\nreajustado anualmente. O próximo reajuste em 03/2025."),
        ("no start", "reajustado pelo IGP-M anualmente."),
    ]
    df = spark.createDataFrame(texts, "id string, text string")
    rows = {r.id: r for r in analyse(df, ref_date="2026-10-06").collect()}
    assert rows["annual"].adjustment_next == date(2027, 3, 1)
    record = rows["annual"].provenance["reajuste_proximo"]
    assert (record.origin, record.confidence, record.needs_review) == ("regra_calculada", 0.45, True)
    assert "01/03/2024" in record.detail and "12 meses" in record.detail
    assert rows["explicit"].adjustment_next == date(2025, 3, 1)
    assert rows["no start"].adjustment_next is None
    assert "reajuste_proximo" in rows["no start"].review_fields
    assert analyse(df).where("id = 'annual'").collect()[0].adjustment_next is None
    assert len(record) == 4 and len(rows["annual"].provenance) == 21


def test_five_alerts(spark):
    row = spark.range(1).select(
        flags_struct(
            F.array(F.lit("caucao"), F.lit("fianca")), F.lit("salário mínimo"), F.lit(6), F.lit(True), F.lit(True)
        ).alias("f"),
        flags_struct(
            F.array(F.lit("caucao"), F.lit("caucao")), F.lit("IPCA"), F.lit(12), F.lit(False), F.lit(False)
        ).alias("g"),
    ).collect()[0]
    assert len(row.f.alerts) == 5
    assert "2 modalidades detectadas (caucao, fianca)" in row.f.alerts[0]
    assert row.g.alerts == [] and not any(row.g[:5])


def test_clauses_and_triage(spark):
    df = spark.createDataFrame(
        [
            ("A locatária renuncia a indenização por benfeitorias necessárias.",),
            ("O locatário abre mão de qualquer benfeitoria realizada.",),
            ("Serão aplicadas cumulativamente a multa moratória e a multa penal.",),
            ("Multa rescisória de três aluguéis em caso de rescisão antecipada.",),
        ],
        "text string",
    )
    rows = compliance_flags(E.extract_fields(df)).collect()
    assert [r.flags.waives_improvements for r in rows] == [True, True, False, False]
    assert [r.flags.cumulates_penalties for r in rows] == [False, False, True, False]
    texts = [("curto",), ("x" * 500,), ("LOCADOR (A): fulano " + "x" * 500,)]
    kinds = triage(spark.createDataFrame(texts, "text string")).collect()
    assert [r.triage for r in kinds] == ["scanned", "other", "contract"]


def test_interpreter_sees_only_unresolved(spark):
    import pandas as pd

    @F.pandas_udf("value string, confidence double, detail string")
    def reply(excerpt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "value": ["COMERCIAL" if e and "loja" in e else "banana" for e in excerpt],
                "confidence": [0.8] * len(excerpt),
                "detail": [e or "nada" for e in excerpt],
            }
        )

    df = spark.createDataFrame(
        [("a", "fins residenciais"), ("b", "imóvel com loja"), ("c", "imóvel")], "id string, text string"
    )
    routed = E.route_ambiguous(E.extract_fields(df, keep_text=True), "text", reply)
    rows = {r.id: r.lease_type for r in routed.collect()}
    assert (rows["a"].value, rows["a"].origin) == ("residencial", "regra")
    assert (rows["b"].value, rows["b"].origin) == ("comercial", "llm")
    assert rows["c"].value is None and rows["c"].origin == "nao_encontrado"


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError):
        E.extract_fields(spark.createDataFrame([("a", 1)], "text string, rent int"))


def test_an_excerpt_is_asked_once(spark, tmp_path):
    import pandas as pd

    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("value string, confidence double, detail string")
    def reply(excerpt: pd.Series) -> pd.DataFrame:
        calls.add(len(excerpt))
        return pd.DataFrame({"value": [None if e == "" else "comercial" for e in excerpt], "confidence": 0.8, "detail": "x"})

    texts = ["imóvel de esquina"] * 40 + ["imóvel de canto"] * 3 + [None, "", "fins residenciais"]
    df = spark.createDataFrame([(i, "own", t) for i, t in enumerate(texts)], "id int, hash string, text string")
    fields = E.extract_fields(df, keep_text=True)
    root = str(tmp_path / "answers")
    for asked in (3, 3):  # two texts and the empty one; nothing new in the second run
        rows = E.route_ambiguous(fields, "text", reply, answers=root).collect()
        assert calls.value == asked and len(rows) == len(texts)
        got = {r.id: (r.lease_type.value, r.hash) for r in rows}
        assert {got[i] for i in range(43)} == {("comercial", "own")} and got[45][0] == "residencial" and got[43] == (None, "own")
    more = E.extract_fields(df.unionByName(df.withColumn("text", F.lit("imóvel novo"))), keep_text=True)
    E.route_ambiguous(more, "text", reply, answers=root).collect()
    assert calls.value == 4
    assert E.route_ambiguous(fields.limit(0), "text", reply).count() == 0


def test_packs_as_tables(spark):
    from leaselake.operators import rule_tables as RT
    from leaselake.plans import lease_ptbr as R

    fields, rules = RT.pack_tables(spark)
    assert RT.read_pack(fields.withColumn("note", F.lit(1)), rules) == R.FIELDS
    add = lambda field, *rows: RT.read_pack(
        fields.unionByName(spark.createDataFrame([field], RT.FIELD_COLUMNS)), rules.unionByName(spark.createDataFrame(list(rows), RT.RULE_COLUMNS))
    )
    own = ("court", "foro", "string", "sem foro", None, None, None, None)
    rule = ("court", 2, r"foro\s+de\s+(\w+)", "text", 0.9, None, None, None, None, None)
    pack = add(own, rule, ("court", 1, r"comarca\s+de\s+(\w+)", "text", 0.7, "comarca", None, None, None, ["comarca"]))
    assert pack[:-1] == R.FIELDS and [r.confidence for r in pack[-1].rules] == [0.7, 0.9]
    df = spark.createDataFrame([(1, "Foro de Santos. Comarca de Itu."), (2, "foro de Campinas"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.court for r in E.extract_fields(df, rules=pack).collect()}
    assert [(got[i].value, got[i].confidence, got[i].detail) for i in (1, 2)] == [("itu", 0.7, "comarca"), ("campinas", 0.9, None)]
    assert [(got[i].value, got[i].origin, got[i].detail) for i in (3, 4)] == [(None, "nao_encontrado", "sem foro")] * 2
    with pytest.raises(ValueError, match="clash"):
        E.extract_fields(df.withColumn("court", F.lit(1)), rules=pack)
    for field, row, message in (
        (own, (*rule[:2], "(", *rule[3:]), "rule 2"),
        (own, (*rule[:2], "foro", *rule[3:]), "rule 2"),
        (own, (*rule[:3], "money", *rule[4:]), "gives no string"),
        (own, (*rule[:3], "constant", *rule[4:]), "constant goes with"),
        (("tenant", *own[1:]), ("tenant", *rule[1:]), "cannot be used"),
        (("court", "locador", *own[2:]), rule, "belongs to another"),
        (own, ("forum", *rule[1:]), "rules without a field"),
        (("court", "foro", "int", "", None, 1, None, None), (*rule[:3], "int", *rule[4:]), "come together"),
    ):
        with pytest.raises(ValueError, match=message):
            add(field, row)
    with pytest.raises(ValueError, match="rent: a field of the default pack is missing"):
        RT.read_pack(fields.where("field <> 'rent'"), rules.where("field <> 'rent'"))


def test_each_pattern_searches_a_text_once():
    """Rules with one pattern share its capture, and no capture is named twice in an expression."""
    from leaselake.plans import lease_ptbr as R

    stage = "\n".join(str(c) for c in E._capture_stage(R.FIELDS))
    searched = {(r.pattern, r.group) for f in R.FIELDS for r in f.rules}
    shown = lambda pattern: pattern.replace("\\", "\\\\").replace("\n", "\\n")
    counts = {p: stage.count(f"{shown(p)}', {g})") + stage.count(f"{shown(p)}')") for p, g in searched}
    assert {p: n for p, n in counts.items() if n != 1} == {}
    assert "nullif" not in stage


def test_payers_are_found_for_each_window(spark):
    """A tie, no label, the nearest label on either side."""
    texts = {
        "o iptu cabe ao locatário e não ao locador": {"iptu": "locatario"},
        "ao locador cabe o iptu, nunca a outro que o locatário": {"iptu": "locador"},
        "o iptu é devido. " + "x" * 120 + " locador": {"iptu": None},
        "locador iptu": {"iptu": "locador"},
        "taxa de administração do locador; " + "y" * 110 + " iptu do locatário": {"iptu": "locatario", "taxa_administracao": "locador"},
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.v for r in E.extract_fields(rows).select("id", F.col("expenses.value").alias("v")).collect()}
    assert got == dict(enumerate(texts.values()))
