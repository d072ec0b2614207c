"""Header keys, case folding, party blocks and the interpreter's share of the rows."""

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from leaselake.functions import text as X
from leaselake.operators import extract as E


def test_header_key_decomposes_all_forms(one):
    samples = ["Razão Social", "ﬁlial", "Nº", "㎏", "ＣＮＰＪ", "½", "Ǆ", "ẞ", "①", "é", "日本", None]

    def want(t):
        folded = unicodedata.normalize("NFKD", (t or "").lower())
        return "".join(c for c in folded if not unicodedata.combining(c))

    assert one(X.header_key, samples) == [want(t) for t in samples]


def test_name_key_folds_case(one):
    samples = ["Strauß", "STRAUSS", "  ÉCLAIR  &  CIA ", "ŉ", "ǰ", "Ω", "ς", None]
    want = [None if t is None else " ".join(t.split()).casefold() for t in samples]
    assert one(X.name_key, samples) == want
    assert want[0] == want[1]


def test_blocks_of_a_party(spark):
    from leaselake.plans import lease_ptbr as R

    cases = {
        "LOCADOR: Ana, CPF 1\n\nfim": ["Ana, CPF 1"],
        "LOCADOR (A/S):\n\nAna\nLOCATÁRIO: Rui": ["Ana\n"],
        "LOCADORA - Ana CLÁUSULA 1": ["Ana "],
        "locador: A\n\nLOCADORES: B": ["A", "B"],
        "LOCADOR: " + "x" * 801: [],
        "LOCADOR: " + "x" * 800: ["x" * 800],
        "LOCADOR: " + "x" * 790 + " LOCADOR: fim": ["fim"],
        "sem rótulo": [],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.b for r in rows.select("t", E.labelled_blocks(F.col("t"), R.LANDLORD_ROOT, R.TENANT_ROOT).alias("b")).collect()}
    assert got == cases


def test_interpreter_sees_unresolved_rows_only(spark):
    from leaselake.plans import lease_ptbr as R

    field = "struct<value:string,confidence:double,origin:string,detail:string>"
    rows = spark.createDataFrame(
        [(1, "um texto", ("residencial", 0.9, "regra", None)), (2, "outro texto", (None, 0.0, "nao_encontrado", None)), (3, "nada", None)],
        f"id int, text string, lease_type {field}",
    )

    @F.pandas_udf("value string, confidence double, detail string")
    def ask(texts: pd.Series) -> pd.DataFrame:
        assert "um texto" not in set(texts)
        return pd.DataFrame({"value": ["comercial" if "outro" in t else "?" for t in texts], "confidence": 0.7, "detail": "d"})

    got = {r.id: r.lease_type for r in E.route_ambiguous(rows, "text", ask).collect()}
    assert got[1].origin == "regra" and (got[2].value, got[2].origin) == ("comercial", "llm")
    assert got[3].detail == R.INTERPRETER_UNDECIDED
    none = {r.id: r.lease_type for r in E.route_ambiguous(rows, "text").collect()}
    assert none[1].value == "residencial" and none[2].detail == R.NO_INTERPRETER
    absent = E.route_ambiguous(rows, "text", lambda c: F.lit(None).cast("struct<value:string,confidence:double,detail:string>"))
    assert {r.id: r.lease_type.detail for r in absent.collect()}[2] == R.INTERPRETER_ABSENT
