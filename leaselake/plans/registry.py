"""Registered queries: each takes (spark, folder of the tables) and returns a DataFrame.

Queries over contracts render the whole order table as contract text and extract
from it. Reports and maintenance read the extracted contracts as a stored table,
written once per session and folder.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaselake import synth
from leaselake.functions import keys as K
from leaselake.functions import labels as L
from leaselake.functions import parsing as P
from leaselake.functions import text as X
from leaselake.operators import brackets as B
from leaselake.operators import buckets as BU
from leaselake.operators import dedup as D
from leaselake.operators import extract as E
from leaselake.operators import linkage as J
from leaselake.operators import maintain as M
from leaselake.operators import normalise as N
from leaselake.operators import portfolio_import as I
from leaselake.operators import report as R
from leaselake.operators import rule_tables as RT
from leaselake.operators.accuracy import accuracy_matrix
from leaselake.operators.compliance import compliance_flags, flags_struct, text_clauses, triage
from leaselake.plans.contracts import analyse
from leaselake.plans import lease_ptbr as RULES
from leaselake.session import stored, work_folder
from leaselake.sources import delimited as S
from leaselake.sources import documents as DOC
from leaselake.sources import tables as TAB
from leaselake.streaming import ingest as STREAM

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_STORED: dict[tuple[str, str, str], DataFrame] = {}
BUCKET_ROWS = 10_000


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and dates as ISO text, the form the SQL twins use."""
    casts = {T.IntegerType: "bigint", T.ShortType: "bigint", T.ByteType: "bigint", T.DateType: "string"}
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(casts[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in casts
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def once(spark: SparkSession, sf_dir: str, purpose: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per session and source folder."""
    key = (spark.sparkContext.applicationId, sf_dir, purpose)
    if key not in _STORED:
        _STORED[key] = stored(build(), purpose)
    return _STORED[key]


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted contracts of all orders, as a stored table."""
    return once(
        spark, sf_dir, "contracts", lambda: analyse(synth.contracts(spark, sf_dir), ref_date=synth.REF_DATE)
    )


def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.build_ledger(analysed(spark, sf_dir), B.brackets_2026(spark), "contract_id")


def links_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = analysed(spark, sf_dir).select(
        "contract_id",
        F.col("tenant.name").alias("tenant_name"),
        F.col("tenant.document").alias("tenant_document"),
    )
    return once(
        spark, sf_dir, "links", lambda: J.link_entities(tenants, synth.portfolio(spark, sf_dir))
    )


def extracted(spark: SparkSession, sf_dir: str, ref_date: str | None = None) -> DataFrame:
    return E.extract_fields(synth.contracts(spark, sf_dir), ref_date=ref_date)


# ---- flagship ---------------------------------------------------------------------------
def compliance_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = analysed(spark, sf_dir)
    ledger = R.build_ledger(contracts, B.brackets_2026(spark), "contract_id")
    links = links_table(spark, sf_dir).select("contract_id", "cnpj", "status", "method")
    return plain(
        ledger.join(links, "contract_id").select(
            "contract_id", "tenant_name", "tenant_document", "landlord_name", "rent", "index",
            "adjustment_next", "due_date", "tax_withheld", "tax_reduction", "cnpj", "status", "method",
            "needs_review",
        )
    )


_QUERIES["compliance_ledger"] = compliance_ledger


# ---- extraction -------------------------------------------------------------------------
@query
def contract_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extracted(spark, sf_dir)
    return df.select(
        "contract_id",
        *[
            F.col(f"{side}.value.{part}").alias(f"{side}_{part}")
            for side in ("landlord", "tenant")
            for part in ("type", "name", "document")
        ],
        F.col("landlord.confidence").alias("landlord_confidence"),
        F.col("tenant.confidence").alias("tenant_confidence"),
        F.col("tenant.detail").alias("tenant_detail"),
    )


@query
def contract_extra_landlords(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("extra_landlords.value")
    return plain(
        extracted(spark, sf_dir).select(
            "contract_id",
            F.size(value).alias("extra"),
            L.extra_landlords_label(value).alias("names"),
            F.get(value, F.lit(0))["document"].alias("document"),
            F.col("extra_landlords.confidence").alias("confidence"),
        )
    )


@query
def contract_rent_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select(
        "contract_id",
        F.col("rent.value").alias("rent"),
        F.col("rent.confidence").alias("rent_confidence"),
        F.col("termination_penalty.value").alias("penalty"),
        F.col("termination_penalty.confidence").alias("penalty_confidence"),
        F.col("termination_penalty.origin").alias("penalty_origin"),
        F.col("termination_penalty.detail").alias("penalty_detail"),
    )


@query
def contract_guarantees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select(
        "contract_id",
        F.array_join("guarantees.value", ",").alias("guarantees"),
        F.col("guarantees.confidence").alias("confidence"),
    )


@query
def contract_term_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("start_date", "end_date", "term_months", "due_day", "grace_months")
    return plain(
        extracted(spark, sf_dir).select(
            "contract_id",
            *[F.col(f"{n}.value").alias(n) for n in names],
            *[F.col(f"{n}.confidence").alias(f"{n}_confidence") for n in names],
        )
    )


@query
def contract_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(
        extracted(spark, sf_dir, synth.REF_DATE).select(
            "contract_id",
            F.col("adjustment_index.value").alias("adjustment_index"),
            F.col("index_source.value").alias("index_source"),
            F.col("adjustment_period_months.value").alias("period_months"),
            F.col("adjustment_next.value").alias("next_date"),
            F.col("adjustment_next.origin").alias("next_origin"),
            F.col("adjustment_next.confidence").alias("next_confidence"),
            F.col("adjustment_automatic.value").alias("automatic"),
            F.col("adjustment_automatic.confidence").alias("automatic_confidence"),
        )
    )


@query
def contract_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select(
        "contract_id",
        L.expenses_label(F.col("expenses.value")).alias("expenses"),
        F.col("expenses.confidence").alias("confidence"),
    )


@query
def contract_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    automatic, months = F.col("renewal_automatic.value"), F.col("renewal_months.value")
    return plain(
        extracted(spark, sf_dir).select(
            "contract_id",
            automatic.alias("automatic"),
            months.alias("months"),
            L.renewal_label(automatic, months).alias("label"),
            F.col("renewal_automatic.confidence").alias("confidence"),
        )
    )


@query
def contract_lease_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select("contract_id", "lease_type.*")


@query
def ambiguous_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interpreter is an Arrow UDF; it sees only the rows the rules left open."""
    fields = E.extract_fields(synth.contracts(spark, sf_dir), keep_text=True)

    @F.pandas_udf("value string, confidence double, detail string")
    def interpreter(excerpts: pd.Series) -> pd.DataFrame:
        seen = excerpts.str.contains("foro da comarca", regex=False)
        return pd.DataFrame({"value": seen.map({True: " Comercial ", False: "banana"}), "confidence": 0.8, "detail": "lido no trecho"})

    return E.route_ambiguous(fields, "text", interpreter).select("contract_id", "lease_type.*")


@query
def own_rule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts by a pack read from tables: the default one with an index renamed, and two fields of its own."""
    fields, rules = RT.pack_tables(spark)
    own = spark.createDataFrame(
        [("grace_days", "carencia_dias", "int", "carência em dias não localizada", None, 1, 365, "fora de faixa: "),
         ("fire_cover", "cobertura_incendio", "string", "sem cobertura", None, None, None, None)], RT.FIELD_COLUMNS,
    )
    own_rules = spark.createDataFrame(
        [("grace_days", 0, r"car[êe]ncia\s+de\s+(\d{1,3})\s+dias", "int", 0.9, None, None, None, None, ["car"]),
         ("fire_cover", 5, r"seguro\s+contra\s+inc[êe]ndio", "constant", 0.8, "pelo contrato", None, "sim", None, None)], RT.RULE_COLUMNS,
    )
    renamed = rules.withColumn("constant", F.when(F.col("constant") == "IPCA", "IPCA (novo)").otherwise(F.col("constant")))
    path = work_folder(spark, "pack")
    fields.unionByName(own).write.parquet(f"{path}/fields")
    renamed.unionByName(own_rules).write.parquet(f"{path}/rules")
    pack = RT.read_pack(spark.read.parquet(f"{path}/fields"), spark.read.parquet(f"{path}/rules"))
    rows = analyse(synth.contracts(spark, sf_dir), rules=pack)
    record = lambda label: F.col("provenance")[label]
    return plain(
        rows.select(
            "contract_id", "rent", "adjustment_index", "grace_days", "fire_cover", record("carencia_dias")["detail"].alias("days_detail"),
            record("cobertura_incendio")["confidence"].alias("cover_confidence"),
            F.array_contains("review_fields", "carencia_dias").alias("days_to_review"),
        )
    )


@query
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = synth.table(spark, sf_dir, "documents")
    return E.with_excerpt(documents, "text", "excerpt").select("doc_id", "excerpt")


@query
def provenance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = E.provenance_long(analysed(spark, sf_dir), "contract_id")
    return long.groupBy("field", "origin").agg(
        F.count("*").alias("records"), F.count_if("needs_review").alias("to_review")
    )


@query
def review_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.review_workload(analysed(spark, sf_dir)).select("field", "documents", "to_review")


@query
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_table(spark, sf_dir).select("contract_id", "needs_review", "review_reason")


@query
def extraction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen fields against the facts the texts were written from; one rent in fifty is made to differ."""
    got = analysed(spark, sf_dir).select(
        "contract_id", "rent", "start_date", "end_date", "term_months", "due_day", "adjustment_index",
        F.col("landlord.type").alias("landlord_type"), F.col("landlord.name").alias("landlord_name"),
        F.col("landlord.document").alias("landlord_document"), F.col("tenant.name").alias("tenant_name"),
        F.col("tenant.document").alias("tenant_document"), "lease_type", "index_source",
        "adjustment_period_months", "grace_months",
    )
    known = F.col("layout") != 3
    truth = synth.facts(spark, sf_dir).select(
        "contract_id",
        F.when(F.col("contract_id") % 50 == 0, F.col("rent") + F.lit("0.01").cast("decimal(18,2)"))
        .otherwise(F.col("rent")).cast("decimal(18,2)").alias("rent"),
        F.when(known, F.col("start_date")).alias("start_date"),
        F.when(known, F.col("end_date")).alias("end_date"),
        F.col("term_months").cast("int").alias("term_months"),
        F.col("due_day").cast("int").alias("due_day"),
        "adjustment_index", "landlord_type", "landlord_name", "landlord_document", "tenant_name", "tenant_document",
        "lease_type", "index_source",
        F.col("period_months").cast("int").alias("adjustment_period_months"),
        F.col("grace_months").cast("int").alias("grace_months"),
    )
    return accuracy_matrix(got, truth, "contract_id", got.columns[1:])


@query
def clause_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single clauses per order: the further ways to state a term, foreign currency, administration fee."""
    k = F.col("o_orderkey")
    years = (k % 9 + 1).cast("string")
    words = F.element_at(F.array(*[F.lit(w) for w in ("dois", "três", "quatro", "cinco", "dez", "vinte e quatro")]), (k % 6 + 1).cast("int"))
    clause = F.element_at(
        F.array(
            F.concat(F.lit("O prazo da locação é de "), words, F.lit(" meses.")),
            F.concat(F.lit("Prazo determinado de "), years, F.lit(" anos.")),
            F.concat(F.lit("Fica ajustado o prazo de "), words, F.lit(" anos.")),
            F.concat(F.lit("Locação pactuada por "), years, F.lit(" meses.")),
            F.lit("O valor segue a variação cambial do dólar."),
            F.lit("A taxa de administração cabe ao LOCADOR."),
            F.lit("O imóvel será usado como escritório."),
        ),
        (k % 7 + 1).cast("int"),
    )
    fields = E.extract_fields(synth.table(spark, sf_dir, "orders").select(k.alias("contract_id"), clause.alias("text")))
    return plain(
        fields.select(
            "contract_id", F.col("term_months.value").alias("term_months"), F.col("term_months.confidence").alias("confidence"),
            F.col("adjustment_index.value").alias("index"), F.col("lease_type.value").alias("lease_type"),
            F.try_element_at("expenses.value", F.lit("taxa_administracao")).alias("administration"),
        )
    )


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of contracts of which some lack the rent and some everything."""
    k = F.col("contract_id")
    contracts = analysed(spark, sf_dir)
    nothing = lambda c: F.when(k % 11 != 0, F.col(c))
    return R.build_ledger(
        contracts.withColumns(
            {"rent": F.when((k % 11 != 0) & (k % 7 != 0), F.col("rent")), "tenant": nothing("tenant"), "landlord": nothing("landlord")}
        ),
        B.brackets_2026(spark), "contract_id",
    )


@query
def ledger_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select(
        "contract_id", "incomplete", "needs_review", F.col("review_reason").contains(RULES.REASON_INCOMPLETE).alias("says_incomplete")
    )


@query
def ledger_without_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hide_empty(_gaps(spark, sf_dir)).select("contract_id", "tenant_name", "rent")


@query
def contract_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage of contracts and documents together."""
    texts = synth.contracts(spark, sf_dir).select("text").unionByName(synth.table(spark, sf_dir, "documents").select("text"))
    return triage(texts).groupBy("triage").agg(F.count("*").alias("documents"))


@query
def document_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage(synth.table(spark, sf_dir, "documents")).groupBy("triage").agg(
        F.count("*").alias("documents")
    )


@query
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction over all texts of the documents table, which hold no leases."""
    fields = E.extract_fields(synth.table(spark, sf_dir, "documents"))
    return fields.groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.count("landlord.value").alias("landlords"),
        F.count("rent.value").alias("rents"),
    )


# ---- compliance ----------------------------------------------------------------------------
@query
def legal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = compliance_flags(extracted(spark, sf_dir))
    return flags.select(
        "contract_id",
        *[
            F.col(f"flags.{n}").alias(n)
            for n in (
                "several_guarantees", "forbidden_index", "short_period", "waives_improvements",
                "cumulates_penalties",
            )
        ],
    )


@query
def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance_flags(extracted(spark, sf_dir)).select(
        "contract_id", F.array_join("flags.alerts", " | ").alias("alerts")
    )


# ---- column functions ----------------------------------------------------------------------
def _raw_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = synth.key_of(F.col("c_custkey") + 1)
    raw = (
        F.when(F.col("c_custkey") % 5 == 0, synth.masked_key(key))
        .when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("  "), key, F.lit("\t")))
        .when(F.col("c_custkey") % 5 == 2, F.substring(key, 3, 12))
        .when(F.col("c_custkey") % 5 == 3, F.lit("sem numero"))
    )
    return synth.table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"), key.alias("key"))


@query
def key_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_keys(spark, sf_dir)
    return rows.withColumn("n", K.normalise_key(F.col("raw"))).select(
        "c_custkey", F.col("n.value").alias("value"), F.col("n.reason").alias("reason"),
        K.looks_like_key(F.col("raw")).alias("looks_like_key"),
        K.digits_only(F.col("raw")).alias("digits"),
    )


@query
def integer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.table(spark, sf_dir, "customer").select(
        "c_custkey", K.key_value(F.col("c_custkey"), integer_input=True).alias("value")
    )


@query
def key_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = synth.key_of(F.col("c_custkey") + 1)
    last = (F.ascii(F.substring(key, 14, 1)) - 48 + 1) % 10
    altered = F.when(
        F.col("c_custkey") % 3 == 0, F.concat(F.substring(key, 1, 13), last.cast("string"))
    ).when(F.col("c_custkey") % 3 == 1, F.repeat((F.col("c_custkey") % 10).cast("string"), 14)).otherwise(key)
    return synth.table(spark, sf_dir, "customer").select(
        "c_custkey",
        K.check_digits(F.lpad((F.col("c_custkey") + 1).cast("string"), 12, "0")).alias("digits"),
        K.valid_check_digits(altered).alias("valid"),
    )


@query
def header_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.header_key(F.col("text")).alias("key")
    )


@query
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t "), "p_type", F.lit("  "), "p_brand", F.lit(" "))
    return synth.table(spark, sf_dir, "part").select("p_partkey", X.name_key(raw).alias("key"))


@query
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = synth.facts(spark, sf_dir)
    text = F.translate(F.format_number("rent", 2), ",.", ".,")
    broken = F.when(F.col("contract_id") % 9 == 0, F.lit("a combinar")).otherwise(text)
    sentence = F.concat(
        F.lit("aluguel de "), L.money_label(F.col("rent")), F.lit(" e multa de "),
        L.money_label(F.col("rent") * 3), F.lit(" e taxa de R$ 50,00"),
    )
    values = P.find_money(sentence)
    return plain(
        facts.select(
            "contract_id",
            P.parse_money(broken).alias("value"),
            F.size(values).alias("found"),
            F.get(values, F.lit(1)).alias("second"),
            F.get(values, F.lit(2)).alias("third"),
        )
    )


@query
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("start_date")
    text = (
        F.when(F.col("contract_id") % 6 == 0, F.concat(F.lit("em "), F.date_format(day, "dd/MM/yyyy"), F.lit(" ou 05/2031")))
        .when(F.col("contract_id") % 6 == 1, F.concat(F.lit("aos "), synth._written(day)))
        .when(F.col("contract_id") % 6 == 2, F.concat(F.lit("de "), F.date_format(day, "MM/yyyy")))
        .when(F.col("contract_id") % 6 == 3, F.lit("31/02/2024 ou 03/2024"))
        .when(F.col("contract_id") % 6 == 4, F.concat(F.lit("5 de brumário de 2024, 04/"), F.year(day).cast("string")))
        .otherwise(F.lit("sem data"))
    )
    return plain(synth.facts(spark, sf_dir).select("contract_id", P.parse_date(text).alias("day")))


@query
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = ("zero", "um", "dois", "três", "quatro", "cinco", "seis", "sete", "oito", "nove")
    teens = ("dez", "onze", "doze", "treze", "quatorze", "quinze", "dezesseis", "dezessete", "dezoito", "dezenove")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    n = F.col("p_partkey") % 50
    ten = F.when(n < 30, F.lit("vinte")).otherwise(F.lit("trinta"))
    words = (
        F.when(n < 10, pick(units, n % 10))
        .when(n < 20, pick(teens, n % 10))
        .when(n >= 40, F.lit("quarenta e um"))
        .when(n % 10 == 0, ten)
        .otherwise(F.concat(ten, F.lit(" e "), pick(units, n % 10)))
    )
    return plain(
        synth.table(spark, sf_dir, "part").select(
            "p_partkey", P.number_from_words(F.initcap(words)).alias("number")
        )
    )


@query
def tax_id_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = synth.facts(spark, sf_dir)
    person = synth.masked_person(synth.person_of(F.col("contract_id") + 20000000000))
    company = synth.masked_key(synth.key_of(F.col("customer_id") + 1))
    text = (
        F.when(F.col("contract_id") % 4 == 0, F.concat(F.lit("CPF "), person, F.lit(" e CNPJ "), company))
        .when(F.col("contract_id") % 4 == 1, F.concat(F.lit("portador do CPF "), person))
        .when(F.col("contract_id") % 4 == 2, F.concat(F.lit("CNPJ "), synth.key_of(F.col("customer_id") + 1)))
        .otherwise(F.lit("sem documento 123"))
    )
    return facts.withColumn("t", K.detect_tax_id(text)).select(
        "contract_id", F.col("t.type").alias("type"), F.col("t.document").alias("document")
    )


@query
def party_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A party against a variant of itself: no document, other document, other case."""
    k = F.col("contract_id")
    facts = synth.facts(spark, sf_dir)
    party = lambda t, n, d: F.struct(t.alias("type"), n.alias("name"), d.alias("document"))
    left = party(F.col("tenant_type"), F.col("tenant_name"), F.when(k % 2 == 0, F.col("tenant_document")))
    right = party(
        F.col("tenant_type"),
        F.when(k % 5 != 0, F.concat(F.lit(" "), F.upper("tenant_name"), F.lit("  "))),
        F.when(k % 3 == 0, F.col("tenant_document")).when(k % 3 == 1, F.lit("00000000000")),
    )
    return facts.select("contract_id", E.same_party(left, right).alias("same"))


@query
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = synth.facts(spark, sf_dir)
    amount = F.when(F.col("contract_id") % 5 != 0, (F.col("rent") * 1000 - 2000000).cast("decimal(18,2)"))
    return facts.select(
        "contract_id",
        L.money_label(amount).alias("money"),
        L.date_label(F.when(F.col("contract_id") % 3 != 0, F.col("end_date"))).alias("day"),
        L.yes_no(F.col("automatic") == 1).alias("yes_no"),
        L.renewal_label(
            F.col("renewal_kind") < 2, F.when(F.col("renewal_kind") == 0, F.col("renewal_months"))
        ).alias("renewal"),
        L.grace_label(F.col("grace_months")).alias("grace"),
    )


@query
def next_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = synth.table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("date")
    period = (F.col("o_orderkey") % 25 - 2).cast("int")
    ref = F.date_add(start, (F.col("o_custkey") % 4000 - 400).cast("int"))
    return plain(orders.select("o_orderkey", P.next_adjustment(start, period, ref).alias("next_date")))


@query
def clean_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(
        F.concat(F.lit(" "), "p_name"), F.lit("  "), F.col("p_type"), F.col("p_name"), F.lit(None).cast("string"),
        F.concat("p_type", F.lit(" ")), F.col("p_brand"),
    )
    return synth.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(P.clean_list(items), "|").alias("items")
    )


@query
def column_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_keys(spark, sf_dir).withColumn(
        "balance", F.when(F.col("c_custkey") % 4 == 0, F.lit("n/d")).otherwise(F.lit("1.234,56"))
    )
    normalised = N.normalise_columns(rows, {"raw": "key", "balance": "money"})
    return N.quality_summary(normalised, ["raw", "balance"])


@query
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    normalised = N.normalise_columns(_raw_keys(spark, sf_dir), {"raw": "key"})
    return N.top_reasons(normalised, ["raw"])


# ---- tax -------------------------------------------------------------------------------------
def _rents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.facts(spark, sf_dir).select(
        "contract_id", "rent", F.when(F.col("contract_id") % 13 != 0, F.col("landlord_type")).alias("landlord_type")
    )


@query
def bracket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.bracket_join(_rents(spark, sf_dir), "rent", B.brackets_2026(spark))
    return found.select("contract_id", "rent", "lo", "hi", "rate", "deduction", "bracket")


@query
def tax_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxed = B.withholding_tax(_rents(spark, sf_dir), "rent", "landlord_type", B.brackets_2026(spark))
    names = (
        "withheld", "amount", "base", "rate", "deduction", "bracket", "version", "before_reduction",
        "reduction", "gross", "simplified_discount",
    )
    return taxed.select("contract_id", *[F.col(f"tax.{n}").alias(n) for n in names])


@query
def tax_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxed = B.withholding_tax(_rents(spark, sf_dir), "rent", "landlord_type", B.brackets_2026(spark))
    return taxed.select("contract_id", F.col("tax.note").alias("note"))


@query
def rent_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rents(spark, sf_dir).select("contract_id", B.reduction(F.col("rent")).alias("reduction"))


def _yearly_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bracket table per order year; bounds grow by the year."""
    years = synth.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    shift = ((F.col("y") - 1990) * 10).cast("decimal(18,2)")
    open_ = F.lit(None).cast("decimal(18,2)")
    return years.select(
        F.col("y").cast("string").alias("version"),
        F.explode(
            F.array(
                F.struct(
                    F.lit(0).cast("decimal(18,2)").alias("lo"), (F.lit(1000) + shift).cast("decimal(18,2)").alias("hi"),
                    F.lit(0).cast("decimal(6,5)").alias("rate"), F.lit(0).cast("decimal(18,2)").alias("deduction"),
                ),
                F.struct(
                    (F.lit(1000) + shift).cast("decimal(18,2)").alias("lo"), open_.alias("hi"),
                    F.lit("0.1").cast("decimal(6,5)").alias("rate"), F.lit(100).cast("decimal(18,2)").alias("deduction"),
                ),
            )
        ).alias("b"),
    ).select(
        "version", "b.*", F.lit("lei").alias("legal_basis"), F.lit("fonte").alias("source_url")
    )


@query
def bracket_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rents = synth.facts(spark, sf_dir).select(
        "contract_id", "rent", F.year("start_date").cast("string").alias("year")
    )
    found = B.bracket_join(rents, "rent", _yearly_brackets(spark, sf_dir), "year")
    return found.select("contract_id", "version", "lo", "hi", "rate", "bracket")


def _priced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Amounts at, just above and just below the bounds of a bracket table per order priority.

    Every distinct amount of a priority's orders is an upper bound. Some brackets reach far down and hide others.
    """
    money = "decimal(18,2)"
    orders = synth.table(spark, sf_dir, "orders").withColumn("hi", F.col("o_totalprice").cast(money))
    deep = F.when(F.pmod(F.floor("hi"), F.lit(50)) == 0, F.lit(5000)).otherwise(1)
    bounds = orders.select(F.col("o_orderpriority").alias("version"), "hi").distinct().withColumn("lo", (F.col("hi") - deep).cast(money))
    top = bounds.groupBy("version").agg(F.max("hi").alias("lo")).withColumn("hi", F.lit(None).cast(money))
    table = bounds.where(F.col("hi") % 10 != 0).unionByName(top).select(
        "version", "lo", "hi", (F.floor("lo") % 7 / 100).cast("decimal(6,5)").alias("rate"),
        F.floor("lo").cast(money).alias("deduction"),
    )
    step = ((F.col("o_custkey") % 3 - 1) * F.lit("0.01").cast("decimal(3,2)")).cast(money)
    amount = F.when(F.col("o_custkey") % 17 == 0, -F.col("hi")).otherwise(F.col("hi") + step).cast(money)
    return orders.select(
        F.col("o_orderkey").alias("contract_id"), amount.alias("rent"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"),
    ), table


@query
def bracket_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup in tables of thousands of brackets."""
    rents, table = _priced(spark, sf_dir)
    found = B.bracket_range_join(rents, "rent", table, "priority", ["contract_id"])
    return found.select("contract_id", "rent", "version", "lo", "hi", "rate", "deduction", "reason")


@query
def bracket_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _yearly_brackets(spark, sf_dir)
    odd = F.col("version").cast("int") % 3
    hi = (
        F.when((odd == 1) & F.col("hi").isNull(), F.lit(9999).cast("decimal(18,2)"))
        .when(odd == 2, F.lit(None).cast("decimal(18,2)"))
        .otherwise(F.col("hi"))
    )
    return B.validate_brackets(tables.withColumn("hi", hi)).select("version", "lo", "violation")


@query
def latest_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TAB.tax_version(_yearly_brackets(spark, sf_dir)).select("version", "lo", "hi", "rate", "deduction")


@query
def bracket_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TAB.tax_versions(_yearly_brackets(spark, sf_dir))
    return rows.select("version", "lo", "rate")


@query
def one_bracket_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _yearly_brackets(spark, sf_dir)
    first = rows.agg(F.min("version")).first()[0]
    return TAB.tax_version(rows, first).select("version", "lo", "hi", "rate")


@query
def replaced_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _yearly_brackets(spark, sf_dir)
    newer = tables.where(F.col("version") >= "2000").withColumn(
        "deduction", (F.col("deduction") + 5).cast("decimal(18,2)")
    )
    return M.upsert_brackets(tables, newer).select("version", "lo", "deduction")


# ---- documents ---------------------------------------------------------------------------------
def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = synth.table(spark, sf_dir, "documents")
    failed = F.when(F.col("source") == "src3", F.lit("ilegível"))
    return documents.select(
        "doc_id", "lang", DOC.content_hash(F.col("text").cast("binary")).alias("hash"), failed.alias("error")
    )


@query
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_by_content(_hashed(spark, sf_dir), "hash", ["doc_id"], "error").select(
        "doc_id", "hash", "status"
    )


@query
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.batch_summary(D.dedup_by_content(_hashed(spark, sf_dir), "hash", ["doc_id"], "error"), "lang")


@query
def only_new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _hashed(spark, sf_dir)
    history = documents.where(F.col("lang") == "en").select(F.col("hash").alias("file_hash"))
    marked = D.only_new(documents.drop("error"), history, "hash")
    return marked.select("doc_id", "already_loaded", "error")


@query
def text_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = synth.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.col("role")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("turn") % 4 != 2, F.col("text")).alias("scan"),
    )
    return DOC.route_text(turns, "text", "scan").select("conv_id", "turn", "text", "method", "error")


@query
def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = synth.table(spark, sf_dir, "events").select(
        "user_id", F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.col("value")).alias("confidence")
    )
    return DOC.word_confidence(words, "user_id").select(
        "user_id", F.round("mean_confidence", 6).alias("mean_confidence"), "low_confidence"
    )


# ---- portfolio import -----------------------------------------------------------------------------
HEADS = (
    ("CNPJ", "Razão Social", "Cidade"),
    ("Empresa", "Nº do CNPJ", "Cidade"),
    ("Documento", "Cliente", "Cidade"),
    ("MAPA DE ALUGUÉIS", "", ""),
    ("  cnpj ", "RAZAO SOCIAL / NOME EMPRESARIAL", "Cidade"),
)


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per nation: header, then one row per customer, in five styles."""
    style = F.col("n_nationkey") % 5
    nations = synth.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", style.alias("style"))
    pick = lambda column: F.element_at(
        F.array(*[F.lit(h[column]) for h in HEADS]), (F.col("style") + 1).cast("int")
    )
    first = nations.select(
        F.concat("n_name", F.lit(".csv")).alias("source"), "style", F.lit(0).cast("long").alias("row"),
        F.array(pick(0), pick(1), pick(2)).alias("cells"),
    )
    second = nations.where(F.col("style") == 3).select(
        F.concat("n_name", F.lit(".csv")).alias("source"), "style", F.lit(1).cast("long").alias("row"),
        F.array(F.lit("CNPJ"), F.lit("Nome"), F.lit("Cidade")).alias("cells"),
    )
    c = F.col("c_custkey")
    number = F.col("c_nationkey") * 1000 + c % 40 + 1
    key = synth.key_of(number)
    key_cell = (
        F.when(c % 19 == 0, F.lit(""))
        .when(c % 17 == 3, F.lit("123"))
        .when(c % 2 == 0, synth.masked_key(key))
        .otherwise(key)
    )
    name_cell = F.when((c % 19 == 0) | (c % 13 == 0), F.lit("")).otherwise(
        F.concat(F.lit("Firma "), "c_mktsegment", F.lit(" "), c.cast("string"))
    )
    customers = synth.table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    body = customers.select(
        F.concat("n_name", F.lit(".csv")).alias("source"), "style", (c + 2).alias("row"),
        F.when(F.col("style") == 1, F.array(name_cell, key_cell, F.col("n_name")))
        .when(c % 23 == 0, F.array(key_cell))
        .when(F.col("style") == 2, F.array(key_cell, name_cell, F.lit("4.000")))
        .otherwise(F.array(key_cell, name_cell, F.col("n_name"))).alias("cells"),
    )
    return first.unionByName(second).unionByName(body).drop("style")


def sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheets as delimited lines, the delimiter by nation name length."""
    delimiter = F.element_at(
        F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.length("source") % 3 + 1).cast("int")
    )
    quoted = F.transform(
        "cells",
        lambda cell: F.when(F.contains(cell, F.lit("FURNITURE")), F.concat(F.lit('"'), cell, F.lit('"'))).otherwise(cell),
    )
    return _sheets(spark, sf_dir).select(
        "source", "row", F.call_function("array_join", quoted, delimiter).alias("value")
    )


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "sheets", lambda: sheet_cells(spark, sf_dir))


def _mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _sheets(spark, sf_dir)
    return rows, once(spark, sf_dir, "roles", lambda: I.map_columns(rows, search_header=True))


@query
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(I.detect_header(_sheets(spark, sf_dir)))


@query
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_mapping(spark, sf_dir)[1])


@query
def default_header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(I.map_columns(_sheets(spark, sf_dir)))


@query
def value_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sheets(spark, sf_dir)
    return plain(I.value_profile(rows, I.detect_header(rows)))


@query
def sheet_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(
        S.cells_long(_sheets(spark, sf_dir)).groupBy("source", "col").agg(F.count("*").alias("cells"))
    )


@query
def sniffed_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.sniff_delimiters(sheet_lines(spark, sf_dir))
    return found.select("source", F.ascii("delimiter").cast("bigint").alias("code"))


@query
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.rows_from_lines(sheet_lines(spark, sf_dir))
    return rows.select("source", "row", F.array_join("cells", "|").alias("cells"))


@query
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.import_rows(*_mapping(spark, sf_dir))


@query
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.import_summary(I.import_rows(*_mapping(spark, sf_dir)), "source")


@query
def source_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.profile_sources(*_mapping(spark, sf_dir))
    return plain(
        found.select(
            "source", "rows", "header_row", "data_rows", F.size("sample").alias("sample_rows"),
            F.col("mapping.key_col").alias("key_col"), F.col("mapping.name_col").alias("name_col"),
        )
    )


@query
def suggested_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.suggested_source(
        _sheets(spark, sf_dir).groupBy("source").agg(F.count("*").alias("rows"))
    )


@query
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_keys(spark, sf_dir).select(
        "c_custkey", F.col("raw").alias("cnpj"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.lit("Nome")).alias("razao_social"),
    )
    return I.validate_records(rows).select("c_custkey", "reason")


@query
def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company records as JSON lines: fields missing, unexpected, of a wrong kind, unusable; lines that are none."""
    key = synth.key_of(F.col("c_custkey") + 1)
    kind = F.col("c_custkey") % 11
    name, start = F.to_json(F.struct(F.col("c_name").alias("razao_social"))), F.concat(F.lit('{"cnpj":"'), key, F.lit('",'))
    rest = F.substring(name, 2, 1000)
    line = (
        F.when(kind == 0, F.concat(start, rest)).when(kind == 1, name).when(kind == 2, F.concat(start, F.lit('"cidade":"Recife",'), rest))
        .when(kind == 3, F.concat(F.lit('{"cnpj":'), F.ltrim(key, F.lit("0")), F.lit(","), rest))
        .when(kind == 4, F.concat(start, F.lit('"razao_social":"  ","aliases":["A",3," A ",""]}')))
        .when(kind == 5, F.concat(start, F.lit('"aliases":["A"," A ","","B"],"ativo":"off",'), rest))
        .when(kind == 6, F.concat(start, F.lit('"ativo":"talvez","created_at":"ontem","aliases":"A","origem_import":null,'), rest))
        .when(kind == 7, F.lit("[1, 2]")).when(kind == 8, F.substring(name, 1, 9)).when(kind == 9, F.concat(start, F.lit('"origem_import":5,"ativo":null,"zona":1,'), rest))
    )
    rows = synth.table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    return I.validate_json(rows).select(
        "c_custkey", "reason", F.col("record.cnpj").alias("cnpj"), F.col("record.razao_social").alias("name"),
        F.array_join("record.aliases", "|").alias("aliases"), F.col("record.ativo").alias("ativo"),
    )


# ---- linkage ----------------------------------------------------------------------------------------
@query
def link_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = synth.facts(spark, sf_dir).select("contract_id", "tenant_document")
    found = J.link_by_key(tenants, synth.portfolio(spark, sf_dir), "contract_id", "tenant_document")
    return found.select("contract_id", F.col("key").alias("cnpj"))


@query
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_table(spark, sf_dir).select("contract_id", "cnpj", "status", "method", "score")


@query
def company_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.company_status(links_table(spark, sf_dir), synth.portfolio(spark, sf_dir)).select(
        "cnpj", "status", "method", "score", "contracts"
    )


@query
def pendencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pendencies(links_table(spark, sf_dir), synth.portfolio(spark, sf_dir)).select("cnpj", "message")


@query
def orphan_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.orphans(links_table(spark, sf_dir)).select("contract_id", "tenant_name", "tenant_document", "best_score")


@query
def compliance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.compliance_totals(links_table(spark, sf_dir), synth.portfolio(spark, sf_dir))


def named_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio of part names, for name matching."""
    empty = F.array().cast("array<string>")
    return synth.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("portfolio_seq"),
        synth.key_of(F.col("p_partkey") + 1).alias("cnpj"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("razao_social"),
        F.array(F.concat_ws(" ", "p_brand", "p_name")).alias("aliases"),
        empty.alias("nomes_fantasia"),
    )


def named_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants under a disturbed part name: other word order, case, one letter lost.

    One in seven also has letters of its own in the middle, one in eleven a name of no company.
    """
    k = F.col("p_partkey")
    lost = (k % 5 + 2).cast("int")
    name = F.concat_ws(" ", F.upper("p_brand"), "p_type", "p_name")
    near = F.concat(F.substring(name, F.lit(1), lost), F.substring(name, lost + 2, F.lit(100)))
    inside = F.substring(F.lit("qzwxkvj"), F.lit(1), (k % 6 + 2).cast("int"))
    tenant = (
        F.when(k % 11 == 0, F.concat(F.lit("Outra Firma Qualquer "), k.cast("string")))
        .when(k % 7 == 0, F.concat(F.substring(near, F.lit(1), F.lit(12)), inside, F.substring(near, F.lit(13), F.lit(100))))
        .otherwise(near)
    )
    return synth.table(spark, sf_dir, "part").select(
        k.alias("contract_id"), tenant.alias("tenant_name"), F.lit(None).cast("string").alias("tenant_document")
    )


def name_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark, sf_dir, "name-links", lambda: J.link_entities(named_tenants(spark, sf_dir), named_companies(spark, sf_dir))
    ).withColumn("score", F.round("score", 6))


@query
def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best company of every tenant name over all candidate names, with its score."""
    return name_links(spark, sf_dir).select("contract_id", "cnpj", "status", "method", "score")


@query
def name_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants that no company name reaches, with the best score of the review band."""
    return J.orphans(name_links(spark, sf_dir)).select("contract_id", "tenant_name", "best_score")


@query
def name_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.company_status(name_links(spark, sf_dir), named_companies(spark, sf_dir)).select(
        "cnpj", "status", "method", "score", "contracts"
    )


@query
def compare_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_tenants(spark, sf_dir).select("contract_id", J.compare_key(F.col("tenant_name")).alias("key"))


@query
def edit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative similarity of every tenant with the company of the same row."""
    both = named_tenants(spark, sf_dir).join(
        named_companies(spark, sf_dir), F.col("contract_id") == F.col("portfolio_seq")
    )
    return both.select(
        "contract_id",
        F.round(J.edit_similarity(F.lower("tenant_name"), F.lower("razao_social")), 6).alias("score"),
    )


@query
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default similarity of every tenant with the company of the same row."""
    both = named_tenants(spark, sf_dir).join(
        named_companies(spark, sf_dir), F.col("contract_id") == F.col("portfolio_seq")
    ).select(
        "contract_id",
        J.compare_key(F.col("tenant_name")).alias("a"),
        J.compare_key(F.col("razao_social")).alias("b"),
    )
    return both.select("contract_id", F.round(J.name_similarity("a", "b"), 6).alias("score"))


@query
def own_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants linked by a measure of the caller's own, among names that end in the same two words."""
    ending = lambda c: F.substring_index(F.lower(c), " ", -2)
    links = J.link_entities(
        named_tenants(spark, sf_dir), named_companies(spark, sf_dir), threshold=80.0, floor=60.0,
        similarity=lambda a, b: J.edit_similarity(F.lower(a), F.lower(b)),
        pairs=lambda names, candidates: names.join(candidates, ending("a") == ending("b")),
    )
    return links.select("contract_id", "cnpj", "status", "method", F.round("score", 6).alias("score"))


# ---- reports ------------------------------------------------------------------------------------------
@query
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(
        ledger_table(spark, sf_dir).select(
            "contract_id", "tenant_name", "tenant_document", "landlord_name", "rent", "index",
            "index_source", "adjustment_next", "adjustment_automatic", "renewal_automatic", "due_date",
            "grace_months", "tax_withheld", "tax_reduction", "incomplete", "needs_review",
        )
    )


@query
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ledger_totals(ledger_table(spark, sf_dir))


@query
def ledger_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.filter_ledger(ledger_table(spark, sf_dir), index="ipca", automatic=True, text="alvorada 1")
    return found.select("contract_id", "tenant_name", "index")


@query
def index_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.index_values(ledger_table(spark, sf_dir))


@query
def ledger_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ledger_display(ledger_table(spark, sf_dir), "contract_id")


@query
def report_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sheet: all rows under the 15 headers, then the total row."""
    rows = R.report_rows(ledger_table(spark, sf_dir), "contract_id")
    return rows.withColumn("section", F.col("section").cast("bigint"))


@query
def compliance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = links_table(spark, sf_dir)
    companies = synth.portfolio(spark, sf_dir)
    return R.compliance_rows(
        J.compliance_totals(links, companies), J.pendencies(links, companies)
    ).select("section", "position", "label", "value").withColumn("section", F.col("section").cast("bigint"))


# ---- maintenance ---------------------------------------------------------------------------------------
@query
def upsert_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = synth.portfolio(spark, sf_dir)
    empty = F.array().cast("array<string>")
    # Every order brings its customer's company again: a key comes many times in one batch.
    imported = synth.table(spark, sf_dir, "orders").select(
        synth.key_of(F.col("o_custkey") * 2 + 1).alias("cnpj"),
        F.concat(F.lit("Novo Nome "), F.col("o_orderkey").cast("string")).alias("razao_social"),
        empty.alias("aliases"), empty.alias("nomes_fantasia"), F.lit(True).alias("ativo"),
        F.lit("planilha.csv").alias("origem_import"),
        (F.col("o_orderkey") + 5000000000).alias("portfolio_seq"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    merged = M.upsert_portfolio(companies, imported)
    return merged.select(
        "cnpj", "razao_social", "ativo", "origem_import", "portfolio_seq",
        F.size("aliases").cast("bigint").alias("aliases"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created_day"),
    )


@query
def imported_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows of all sheets merged into the portfolio; sheets share companies."""
    companies = synth.portfolio(spark, sf_dir)
    outcomes = I.import_rows(*_mapping(spark, sf_dir))
    records = I.imported_companies(outcomes, companies, F.lit("2026-03-03 00:00:00").cast("timestamp"))
    return M.upsert_portfolio(companies, records).select(
        "cnpj", "razao_social", "origem_import", "portfolio_seq", F.date_format("created_at", "yyyy-MM-dd").alias("created_day")
    )


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history record per order; the hash is that of the order key."""
    return synth.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("arquivo_"), F.col("o_orderkey").cast("string")).alias("file_name"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"),
        F.col("o_orderdate").cast("timestamp").alias("processed_at"),
        (F.col("o_orderkey") % 2 == 0).alias("needs_review"),
        F.col("o_orderstatus"),
    )


def _history_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored records, and arriving ones of which each file comes twice, a day apart."""
    rows = _history(spark, sf_dir)
    old = rows.where(F.col("o_orderstatus").isin("F", "O")).drop("o_orderstatus").withColumn(
        "id", F.concat(F.lit("antigo-"), "file_name")
    )
    arriving = rows.where(F.col("o_orderstatus").isin("O", "P")).drop("o_orderstatus")
    return old, arriving.withColumn("file_name", F.concat("file_name", F.lit("_v2"))).withColumn(
        "processed_at", F.col("processed_at") + F.expr("INTERVAL 1 DAY")
    ).unionByName(arriving.withColumn("file_name", F.concat("file_name", F.lit("_v1"))))


def _history_rows(history: DataFrame) -> DataFrame:
    return history.select(
        "id", "file_name", "file_hash", "needs_review", F.date_format("processed_at", "yyyy-MM-dd").alias("day")
    )


@query
def upsert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_rows(M.upsert_history(*_history_batch(spark, sf_dir), ["processed_at"]))


@query
def bucketed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert on a stored table in buckets, half of the files after the other half."""
    old, new = _history_batch(spark, sf_dir)
    root, buckets = work_folder(spark, "history"), BU.bucket_count(old, BUCKET_ROWS)
    BU.create_buckets(old, root, "file_hash", buckets)
    for half in ("0", "1"):
        part = new.where(F.substring("file_hash", 1, 1) < "8" if half == "0" else F.substring("file_hash", 1, 1) >= "8")
        BU.upsert_history_buckets(spark, root, part, buckets, ["processed_at"])
    return _history_rows(BU.read_buckets(spark, root, "file_hash"))


@query
def history_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TAB.history_view(_history(spark, sf_dir)).select("file_name", "file_hash")


@query
def portfolio_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TAB.portfolio_view(synth.portfolio(spark, sf_dir)).select("cnpj", "razao_social")


@query
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax records to JSON text and back; decimals keep every digit."""
    taxed = B.withholding_tax(_rents(spark, sf_dir), "rent", "landlord_type", B.brackets_2026(spark))
    record = taxed.select("contract_id", "rent", F.col("tax.amount").alias("amount"), F.col("tax.rate").alias("rate"))
    schema = record.schema
    text = record.select(TAB.record_to_json(record, record.columns).alias("json"))
    return text.select(TAB.record_from_json(F.col("json"), schema).alias("r")).select("r.*")


@query
def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of one content hash, that of the least order key, from a history stored for lookups."""
    least = synth.table(spark, sf_dir, "orders").agg(F.sha2(F.min("o_orderkey").cast("string"), 256)).first()[0]
    path = work_folder(spark, "lookup")
    TAB.save_history(_history(spark, sf_dir), path)
    return TAB.history_by_hash(spark.read.parquet(path), least).select("file_name", "file_hash")


@query
def contract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole contracts, nested parties, lists, maps and nulls, to JSON text and back."""
    contracts = analysed(spark, sf_dir)
    text = contracts.select(TAB.record_to_json(contracts, contracts.columns).alias("json"))
    back = text.select("json", TAB.record_from_json(F.col("json"), contracts.schema).alias("r")).select("json", "r.*")
    again = TAB.record_to_json(back.drop("json"), contracts.columns)
    return back.select(
        "contract_id", F.col("tenant.name").alias("tenant_name"), "rent", (F.col("json") == again).alias("same")
    )


@query
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one name in folders of their own, some not in UTF-8, read back as a list."""
    path = work_folder(spark, "files")
    documents = synth.table(spark, sf_dir, "documents")
    raw = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.encode("text", "ISO-8859-1").cast("string"))
    documents.select("doc_id", raw.alias("value")).repartition("doc_id").write.partitionBy("doc_id").text(path)
    files = DOC.list_files(spark, path, recursive=True).select("path")
    listed = files.unionByName(spark.createDataFrame([(f"{path}/doc_id=-1/nada.txt",)], "path string"))
    found = DOC.scan_listed(spark, listed, path, recursive=True)
    number = F.regexp_extract("path", r"doc_id=(-?\d+)/", 1).cast("bigint")
    return found.select(number.alias("doc_id"), "text", "error")


@query
def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as delimited files of equal names in two folders, in two encodings, with line breaks in cells."""
    path = work_folder(spark, "sheets")
    key = F.col("c_custkey")
    name = F.concat(
        F.col("c_name"), F.lit(" & irmã"), F.when(key % 5 == 0, F.lit('\nfilial; "centro", sul')).otherwise(F.lit(""))
    )
    rows = synth.table(spark, sf_dir, "customer").select(key.alias("k"), name.alias("name"), F.col("c_nationkey").alias("n"))
    for encoding, delimiter in (("UTF-8", ";"), ("ISO-8859-1", ",")):
        both = rows.withColumn("folder", F.explode(F.array(F.lit("a"), F.lit("b")))).repartition("k")
        both = both.where(F.pmod("k", F.lit(2)) == (0 if encoding == "UTF-8" else 1))
        both.write.option("encoding", encoding).option("sep", delimiter).option("quoteAll", "true").option(
            "escape", '"'
        ).partitionBy("folder").csv(f"{path}/{encoding}")
    read = S.read_rows(spark, [f"{path}/{e}/folder={f}" for e in ("UTF-8", "ISO-8859-1") for f in ("a", "b")])
    return read.select(F.regexp_extract("source", "folder=(.)", 1).alias("folder"), F.array_join("cells", "|").alias("cells"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    op = (
        F.when(F.col("o_orderstatus") == "F", F.lit("edit"))
        .when(F.col("o_orderstatus") == "O", F.lit("insert"))
        .otherwise(F.lit("remove"))
    )
    name = (
        F.when(k % 11 == 0, F.lit("  "))
        .when((op == "edit") & (k % 3 == 0), F.lit(None))
        .otherwise(F.concat(F.lit(" Nome "), k.cast("string")))
    )
    return synth.table(spark, sf_dir, "orders").select(
        k.alias("seq"),
        op.alias("op"),
        F.when(k % 37 == 0, F.lit("12")).otherwise(synth.key_of(F.col("o_custkey") * 2 + 1)).alias("cnpj"),
        name.alias("razao_social"),
        # Lists with blanks, empty and repeated entries; some empty as a whole.
        F.when(k % 10 == 0, F.array().cast("array<string>")).when(
            k % 5 == 0, F.array(F.concat(F.lit("  Apelido "), k.cast("string")), F.lit(" "), F.concat(F.lit("Apelido "), k.cast("string")), F.lit("Outro"))
        ).alias("aliases"),
        F.when(k % 7 == 0, F.array(F.lit("Fantasia "), F.concat(F.lit("Loja "), k.cast("string")))).alias("nomes_fantasia"),
        F.when(k % 4 == 0, F.lit(False)).alias("ativo"),
    )


@query
def judged_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = M.judge_changes(synth.portfolio(spark, sf_dir), _changes(spark, sf_dir))
    return judged.select("seq", "op", "cnpj", "reason", "effective")


def _changed_rows(companies: DataFrame) -> DataFrame:
    return companies.select(
        "cnpj", "razao_social", "ativo", "origem_import", "portfolio_seq", F.array_join("aliases", "|").alias("aliases"),
        F.array_join("nomes_fantasia", "|").alias("nomes_fantasia"), F.date_format("created_at", "yyyy-MM-dd").alias("created_day"),
    )


@query
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = synth.portfolio(spark, sf_dir)
    judged = M.judge_changes(companies, _changes(spark, sf_dir))
    return _changed_rows(M.apply_changes(companies, judged, F.lit("2026-02-02 00:00:00").cast("timestamp")))


@query
def bucketed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same change set on a stored portfolio in buckets."""
    companies = synth.portfolio(spark, sf_dir)
    root, buckets = work_folder(spark, "portfolio"), BU.bucket_count(companies, BUCKET_ROWS)
    BU.create_buckets(companies, root, "cnpj", buckets)
    BU.apply_changes_to_buckets(spark, root, _changes(spark, sf_dir), buckets, F.lit("2026-02-02 00:00:00").cast("timestamp"))
    return _changed_rows(BU.read_buckets(spark, root, "cnpj"))


@query
def deleted_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = synth.portfolio(spark, sf_dir)
    gone = synth.table(spark, sf_dir, "supplier").select(
        synth.key_of(F.col("s_suppkey") * 3 + 1).alias("cnpj")
    )
    kept, deleted = M.delete_keys(companies, gone, "cnpj")
    return kept.agg(F.count("*").alias("kept")).select("kept", deleted.scalar().alias("deleted"))


@query
def truncated_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, deleted = M.truncate(synth.portfolio(spark, sf_dir))
    return kept.agg(F.count("*").alias("kept")).select("kept", deleted.scalar().alias("deleted"))


def _aging(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("contract_id")
    early = P.next_adjustment(
        F.col("start_date"), F.coalesce(F.col("period_months"), F.lit(12)).cast("int"), F.lit("2024-01-01").cast("date")
    )
    return synth.facts(spark, sf_dir).select(
        "contract_id",
        F.when(k % 5 != 0, F.col("start_date")).alias("start_date"),
        F.col("period_months").cast("int").alias("adjustment_period_months"),
        early.alias("adjustment_next"),
        F.when(k % 3 == 0, F.lit(RULES.BY_RULE)).otherwise(F.lit(RULES.BY_CALCULATION)).alias("next_origin"),
    )


@query
def refreshed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.refresh_dates(_aging(spark, sf_dir), synth.REF_DATE, origin=F.col("next_origin"))
    return plain(rows.select("contract_id", "adjustment_next", "refreshed"))


@query
def refreshed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.refreshed_count(M.refresh_dates(_aging(spark, sf_dir), synth.REF_DATE, origin=F.col("next_origin")))


@query
def stored_contract_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh of extracted contracts by their own provenance, a year later."""
    rows = M.refresh_dates(analysed(spark, sf_dir), "2027-10-06")
    return plain(rows.select("contract_id", "adjustment_next", "refreshed"))


@query
def reject_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects of the import and of the change set in one list, counted per reason kind."""
    imports = I.import_rows(*_mapping(spark, sf_dir)).where(F.col("status") == I.ERROR).select(
        F.lit("import").alias("stage"), "reason"
    )
    changes = M.judge_changes(synth.portfolio(spark, sf_dir), _changes(spark, sf_dir)).where(
        F.col("reason").isNotNull()
    ).select(F.lit("changes").alias("stage"), "reason")
    return D.union_rejects([imports, changes]).groupBy("stage").agg(F.count("reason").alias("rejects"))


# ---- streaming ---------------------------------------------------------------------------------------------
def _stream_of(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """The rows of a table as a stream of files."""
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in some five arrivals, each with events of the whole time, so that most come late."""
    events = synth.table(spark, sf_dir, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("hash"), F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )
    path, files = work_folder(spark, "events"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    events.repartition(files, "event_id").write.parquet(path)
    arriving = spark.readStream.schema("hash string, ts timestamp, event_id long").option("maxFilesPerTrigger", -(-files // 5)).parquet(path)
    out = work_folder(spark, "dedup")
    STREAM.stream_dedup(arriving, "hash", ["ts", "event_id"], f"{out}/first", f"{out}/checkpoint").awaitTermination()
    return STREAM.first_events(spark, f"{out}/first", "hash", ["ts", "event_id"]).select("hash", "event_id", F.unix_micros("ts").alias("ts"))


@query
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rendered contracts, each twice, in some four arrivals through the incremental ingest, with three folds."""
    texts = synth.contracts(spark, sf_dir).select(
        F.concat(F.lit("/entrada/"), "file_name").alias("path"), "file_name",
        F.col("file_name").alias("order_key"),
        DOC.content_hash(F.col("text").cast("binary")).alias("hash"), "text",
    )
    twice = texts.unionByName(
        texts.withColumns({"path": F.concat("path", F.lit(".copia")), "order_key": F.concat("order_key", F.lit(".copia"))})
    )
    out, files = work_folder(spark, "history"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_folder(spark, "arrivals")
    twice.repartition(files, "path").write.parquet(path)
    arriving = spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(path)
    buckets = BU.bucket_count(texts.select("file_name"), BUCKET_ROWS)

    def fold(batch_id: int) -> None:
        if batch_id < 3:  # the last batches stay above the base
            STREAM.fold_history(spark, f"{out}/history", f"{out}/base", buckets)

    STREAM.stream_ingest(
        arriving, f"{out}/history", f"{out}/checkpoint", synth.REF_DATE,
        F.lit("2026-10-06 00:00:00").cast("timestamp"), after_batch=fold,
    ).awaitTermination()
    history = STREAM.read_folded_history(spark, f"{out}/history", f"{out}/base")
    return history.select(
        "file_name", "needs_review", F.col("contract.rent").alias("rent"),
        F.col("contract.tenant.document").alias("tenant_document"),
    )


@query
def stream_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = synth.facts(spark, sf_dir, spread=True).select("contract_id", "tenant_name", "tenant_document")
    out = work_folder(spark, "links")
    STREAM.stream_link(
        _stream_of(spark, tenants, "tenants"), synth.portfolio(spark, sf_dir), f"{out}/links", f"{out}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{out}/links").select("contract_id", "cnpj", "status", "method", "score")


@query
def stream_links_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts in two halves; between them the portfolio gets companies and loses others."""
    tenants = synth.facts(spark, sf_dir).select("contract_id", F.lit(None).cast("string").alias("tenant_name"), "tenant_document")
    companies = synth.portfolio(spark, sf_dir)
    base = work_folder(spark, "versions")
    for half, left_out in ((0, F.col("portfolio_seq") % 3 == 0), (1, F.col("portfolio_seq") % 5 == 1)):
        tenants.where(F.col("contract_id") % 2 == half).write.mode("append").parquet(f"{base}/tenants")
        TAB.save_version(companies.where(~left_out), f"{base}/portfolio")
        arriving = spark.readStream.schema(tenants.schema).parquet(f"{base}/tenants")
        STREAM.stream_link_versions(arriving, f"{base}/portfolio", f"{base}/links", f"{base}/checkpoint").awaitTermination()
    return STREAM.current_links(spark, f"{base}/links").select("contract_id", "cnpj", "status", "method", "score", "portfolio_version")


@query
def clause_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags computed from plain columns and the text, without the extraction."""
    facts = synth.facts(spark, sf_dir, spread=True)
    texts = synth.render(facts)
    # The planner takes rendered texts for short columns; a broadcast would bring all of them to the driver.
    joined = facts.select(
        "contract_id", "adjustment_index", F.col("period_months").cast("int").alias("period"), "guarantee_kind"
    ).hint("merge").join(texts.hint("merge"), "contract_id")
    clauses = text_clauses(X.fold_case(F.col("text")))
    guarantees = F.when(F.col("guarantee_kind") == 4, F.array(F.lit("caucao"), F.lit("fianca"), F.lit("caucao"))).otherwise(
        F.array(F.lit("caucao"), F.lit("caucao"))
    )
    flags = flags_struct(
        guarantees, F.col("adjustment_index"), F.col("period"),
        clauses["waives_improvements"], clauses["cumulates_penalties"],
    )
    return plain(joined.select("contract_id", F.size(flags["alerts"]).alias("alerts")))
