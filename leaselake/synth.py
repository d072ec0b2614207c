"""Lease contracts rendered from the order tables, for checks and benchmarks.

The rental facts of a contract are integer arithmetic on the order and customer
keys (``FACTS_SQL``, valid in Spark SQL and in DuckDB alike). Spark renders them as
pt-BR contract text in four layouts; a check then compares the fields extracted
from the text with the facts it was written from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaselake.functions.keys import check_digits
from leaselake.functions.labels import money_label

REF_DATE = "2026-10-06"

FACTS_SQL = """
SELECT
  o_orderkey AS contract_id,
  o_custkey AS customer_id,
  o_orderkey % 4 AS layout,
  CAST(o_orderdate AS DATE) AS start_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'PJ' ELSE 'PF' END AS landlord_type,
  CASE WHEN o_orderkey % 10 = 7 THEN 'PF' ELSE 'PJ' END AS tenant_type,
  CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS co_owner,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'residencial'
       ELSE 'comercial' END AS lease_type,
  CAST(50000 + (o_orderkey * 137) % 950000 AS BIGINT) AS rent_cents,
  o_orderkey % 3 AS penalty_kind,
  2 + o_orderkey % 5 AS penalty_rents,
  o_orderkey % 5 AS guarantee_kind,
  CASE o_orderkey % 5 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 30 WHEN 3 THEN 36 ELSE 48 END
    AS term_months,
  1 + o_orderkey % 28 AS due_day,
  CASE WHEN o_orderkey % 5 = 1 THEN 1 + o_orderkey % 6 END AS grace_months,
  CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE 0 END AS grace_in_days,
  CASE o_orderkey % 7 WHEN 0 THEN 'IGP-M' WHEN 1 THEN 'IPCA' WHEN 2 THEN 'INPC'
       WHEN 3 THEN 'IGP-DI' WHEN 4 THEN 'INCC' WHEN 5 THEN 'salário mínimo' END AS adjustment_index,
  CASE WHEN o_orderkey % 7 < 5 AND o_orderkey % 2 = 1 THEN
       CASE WHEN o_orderkey % 7 IN (0, 3) THEN 'FGV' ELSE 'IBGE' END END AS index_source,
  CASE (o_orderkey + 1) % 4 WHEN 0 THEN 12 WHEN 1 THEN 6 WHEN 2 THEN 18 END AS period_months,
  CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS explicit_next,
  2027 + o_orderkey % 3 AS next_year,
  1 + o_orderkey % 12 AS next_month,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS automatic,
  (o_orderkey + 1) % 3 AS renewal_kind,
  6 + o_orderkey % 7 AS renewal_months,
  CASE WHEN o_orderkey % 2 = 0 THEN 'locatario' ELSE 'locador' END AS iptu_payer,
  CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS condo_split,
  CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS fire_insurance,
  CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS waives,
  CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS cumulates
FROM {orders}
"""

MONTH_NAMES = (
    "janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro",
    "outubro", "novembro", "dezembro",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(number: Column) -> Column:
    """14-digit company key of a running number: 12 digits and check digits."""
    base = F.lpad(number.cast("string"), 12, "0")
    return F.concat(base, check_digits(base))


def person_of(number: Column) -> Column:
    return F.lpad(number.cast("string"), 11, "0")


def masked_key(key: Column) -> Column:
    return F.regexp_replace(key, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", r"$1.$2.$3/$4-$5")


def masked_person(doc: Column) -> Column:
    return F.regexp_replace(doc, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", r"$1.$2.$3-$4")


def facts(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Facts of every order's contract, with the identifiers spelled out; ``spread``: by all tasks, dealt by the key.

    The order table may be one small file, which one task reads.
    """
    orders = table(spark, sf_dir, "orders")
    if spread:
        orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    base = spark.sql(FACTS_SQL, orders=orders)
    k, c = F.col("contract_id"), F.col("customer_id")
    pj = F.col("landlord_type") == "PJ"
    company = F.col("tenant_type") == "PJ"
    return base.withColumns(
        {
            "landlord_name": F.when(pj, F.concat(F.lit("Imobiliária Serra "), k.cast("string"), F.lit(" LTDA")))
            .otherwise(F.concat(F.lit("Helena Moura "), k.cast("string"))),
            "landlord_document": F.when(pj, key_of(k + 500000000000)).otherwise(person_of(k + 10000000000)),
            "co_owner_name": F.concat(F.lit("Ana Prado "), k.cast("string")),
            "co_owner_document": person_of(k + 30000000000),
            "tenant_name": F.when(company, F.concat(F.lit("Comércio Alvorada "), c.cast("string"), F.lit(" LTDA")))
            .otherwise(F.concat(F.lit("Pedro Lima "), k.cast("string"))),
            "tenant_document": F.when(company, key_of(c + 1)).otherwise(person_of(k + 20000000000)),
            "rent": (F.col("rent_cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)"),
            "end_date": F.date_sub(F.add_months("start_date", F.col("term_months")), 1),
        }
    )


def _line(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _n(name: str) -> Column:
    return F.col(name).cast("string")


def _written(day: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return _line(
        F.day(day).cast("string"), " de ", F.element_at(names, F.month(day)), " de ", F.year(day).cast("string")
    )


def _document(kind: str, document: str) -> Column:
    return F.when(
        F.col(kind) == "PJ", _line("inscrita no CNPJ nº ", masked_key(F.col(document)))
    ).otherwise(_line("portador do CPF nº ", masked_person(F.col(document))))


def render(df: DataFrame) -> DataFrame:
    """contract_id, file_name and text of every row of facts."""
    landlord = _line(F.col("landlord_name"), ", ", _document("landlord_type", "landlord_document"))
    tenant = _line(F.col("tenant_name"), ", ", _document("tenant_type", "tenant_document"))
    layout = F.col("layout")
    title = F.when(layout == 3, F.lit("CONTRATO DE LOCAÇÃO")).otherwise(
        _line("CONTRATO DE LOCAÇÃO ", F.upper("lease_type"))
    )
    parties = (
        F.when(layout == 0, _line("LOCADOR: ", landlord, ".\n\nLOCATÁRIO: ", tenant, ".\n\n"))
        .when(
            layout == 1,
            _line("LOCADOR (A/S/ES):\n\n", landlord, ".\n\n LOCATÁRIOS (A/S):\n\n", tenant, ".\n\n"),
        )
        .when(
            layout == 2,
            _line(
                "Celebram este instrumento, de um lado, como LOCADORA e aqui doravante assim denominada, ",
                landlord, ", e do outro, como LOCATÁRIO, ", tenant, ", mediante as condições seguintes.\n\n",
            ),
        )
        .otherwise(_line("LOCADOR(A): ", landlord, ".\n\nLOCATÁRIO(A): ", tenant, ".\n\n"))
    )
    co_owner = F.when(
        F.col("co_owner") == 1,
        _line("LOCADOR: ", F.col("co_owner_name"), ", portadora do CPF nº ",
              masked_person(F.col("co_owner_document")), ".\n\n"),
    ).otherwise(F.lit(""))
    money = money_label(F.col("rent"))
    rent = (
        F.when(layout == 0, _line("O valor do aluguel mensal é de ", money))
        .when(layout == 1, _line("O preço mensal da locação importa em ", money))
        .when(layout == 2, _line("O valor mensal da locação corresponde a ", money))
        .otherwise(_line("O aluguel é de ", money))
    )
    due = (
        F.when(layout % 2 == 0, _line(", com vencimento todo dia ", _n("due_day"), ".\n\n"))
        .otherwise(_line(", a ser pago até o dia ", _n("due_day"), " de cada mês.\n\n"))
    )
    day = lambda name: F.date_format(name, "dd/MM/yyyy")
    dates = (
        F.when(layout == 0, _line(", com início em ", day("start_date"), " e término em ", day("end_date")))
        .when(
            layout == 1,
            _line(", com vigência de ", _written(F.col("start_date")), " a ", _written(F.col("end_date"))),
        )
        .when(layout == 2, _line(", de ", day("start_date"), " até ", day("end_date")))
        .otherwise(F.lit(""))
    )
    term = _line("O prazo da locação é de ", _n("term_months"), " meses", dates, ".\n\n")
    guarantee = F.element_at(
        F.array(
            F.lit("Como garantia é prestada caução em dinheiro.\n\n"),
            F.lit("A garantia é o seguro-fiança contratado em seguradora idônea.\n\n"),
            F.lit("A garantia é a cessão fiduciária de quotas de fundo.\n\n"),
            F.lit("A garantia é dada por fiador idôneo.\n\n"),
            F.lit("São garantias a caução em dinheiro e a fiança de terceiro.\n\n"),
        ),
        (F.col("guarantee_kind") + 1).cast("int"),
    )
    index = F.when(F.col("adjustment_index").isNull(), F.lit("")).otherwise(
        _line(
            "O valor será corrigido pela variação do ", F.col("adjustment_index"),
            F.coalesce(_line("/", F.col("index_source")), F.lit("")), " acumulado.\n\n",
        )
    )
    period = F.coalesce(
        F.when(F.col("period_months") == 12, F.lit("A correção será feita anualmente.\n\n"))
        .when(F.col("period_months") == 6, F.lit("A correção será semestral.\n\n"))
        .when(F.col("period_months") == 18, F.lit("A correção será feita a cada 18 meses.\n\n")),
        F.lit(""),
    )
    following = F.when(
        F.col("explicit_next") == 1,
        _line("Fica acordado o próximo reajuste em ", F.lpad(_n("next_month"), 2, "0"), "/", _n("next_year"), ".\n\n"),
    ).otherwise(F.lit(""))
    automatic = F.when(
        F.col("automatic") == 1, F.lit("O reajuste será automático.\n\n")
    ).otherwise(F.lit(""))
    penalty = (
        F.when(F.col("penalty_kind") == 0, _line("A multa por rescisão é de ", money_label(F.col("rent") * 3), ".\n\n"))
        .when(
            F.col("penalty_kind") == 1,
            _line("A multa por rescisão equivale a ", _n("penalty_rents"), " aluguéis vigentes.\n\n"),
        )
        .otherwise(F.lit(""))
    )
    grace = (
        F.when(F.col("grace_months").isNotNull(), _line("Há carência de ", _n("grace_months"), " meses.\n\n"))
        .when(F.col("grace_in_days") == 1, F.lit("Há carência de 45 dias.\n\n"))
        .otherwise(F.lit(""))
    )
    iptu = F.when(
        F.col("iptu_payer") == "locatario", F.lit("O IPTU será pago pelo LOCATÁRIO.\n\n")
    ).otherwise(F.lit("O IPTU será pago pelo LOCADOR.\n\n"))
    filler = "As partes declaram ter lido e compreendido todas as condições, que aceitam sem ressalva alguma, " \
        "e elegem o foro da comarca da situação do imóvel para dirimir dúvidas.\n\n"
    condo = F.when(
        F.col("condo_split") == 1,
        F.lit(
            filler
            + "As despesas ordinárias de condomínio ficam a cargo do LOCATÁRIO, enquanto as despesas "
            "extraordinárias de condomínio serão de responsabilidade do LOCADOR.\n\n" + filler
        ),
    ).otherwise(F.lit(filler))
    fire = F.when(
        F.col("fire_insurance") == 1,
        F.lit("Cabe a contratação de seguro contra incêndio pelo LOCATÁRIO.\n\n" + filler),
    ).otherwise(F.lit(""))
    renewal = (
        F.when(
            F.col("renewal_kind") == 0,
            _line("O instrumento será prorrogado automaticamente por ", _n("renewal_months"), " meses.\n\n"),
        )
        .when(F.col("renewal_kind") == 1, F.lit("O instrumento será renovado de forma automatica.\n\n"))
        .otherwise(F.lit(""))
    )
    waiver = F.when(
        F.col("waives") == 1, F.lit("A parte ocupante renuncia a indenização por benfeitorias necessárias.\n\n")
    ).otherwise(F.lit(""))
    cumulative = F.when(
        F.col("cumulates") == 1, F.lit("Aplica-se cumulativamente a multa moratória e a penal.\n\n")
    ).otherwise(F.lit(""))
    text = F.concat(
        title, F.lit("\n\n"), parties, co_owner, rent, due, term, guarantee, index, period, following,
        automatic, penalty, grace, iptu, condo, fire, renewal, waiver, cumulative,
    )
    name = F.concat(F.lit("contrato_"), F.lpad(_n("contract_id"), 9, "0"), F.lit(".txt"))
    return df.select("contract_id", name.alias("file_name"), text.alias("text"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract texts of all orders, rendered and read by all tasks."""
    return render(facts(spark, sf_dir, spread=True))


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies: every customer, and every supplier (which rents nothing)."""
    empty = F.array().cast("array<string>")
    customers = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("portfolio_seq"),
        key_of(F.col("c_custkey") + 1).alias("cnpj"),
        F.concat(F.lit("Comércio Alvorada "), F.col("c_custkey").cast("string"), F.lit(" LTDA")).alias("razao_social"),
        F.array("c_name").alias("aliases"),
        empty.alias("nomes_fantasia"),
        (F.col("c_custkey") % 7 != 0).alias("ativo"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1000000000).alias("portfolio_seq"),
        key_of(F.col("s_suppkey") + 900000000000).alias("cnpj"),
        F.concat(F.lit("Fornecedora Litoral "), F.col("s_suppkey").cast("string"), F.lit(" SA")).alias("razao_social"),
        F.array("s_name").alias("aliases"),
        empty.alias("nomes_fantasia"),
        F.lit(True).alias("ativo"),
    )
    return customers.unionByName(suppliers).withColumns(
        {
            "origem_import": F.lit("carga"),
            "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp"),
        }
    )
