"""SQL twins of the registered queries, for DuckDB over the same tables.

They compute the expected results from the order, customer and supplier columns
with plain SQL; no extraction pattern of the library appears here.
"""

from __future__ import annotations

from leaselake.operators.report import HEADERS
from leaselake.plans.tax_tables import BRACKETS_2026, NEGATIVE_BASE
from leaselake.synth import FACTS_SQL, MONTH_NAMES, REF_DATE

W1 = "[5,4,3,2,9,8,7,6,5,4,3,2]"
W2 = "[6,5,4,3,2,9,8,7,6,5,4,3]"


def _sum(base: str, weights: str) -> str:
    return (
        f"list_sum([CAST(substr({base}, CAST(i AS INT), 1) AS INT) * {weights}[CAST(i AS INT)] "
        f"for i in range(1, 13)])"
    )


def _digit(total: str) -> str:
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


def key(number: str) -> str:
    base = f"lpad(CAST({number} AS VARCHAR), 12, '0')"
    first = _digit(_sum(base, W1))
    second = _digit(f"{_sum(base, W2)} + 2 * {first}")
    return f"({base} || CAST({first} AS VARCHAR) || CAST({second} AS VARCHAR))"


def check(number: str) -> str:
    return f"substr({key(number)}, 13, 2)"


def person(number: str) -> str:
    return f"lpad(CAST({number} AS VARCHAR), 11, '0')"


def masked(k: str) -> str:
    return (
        f"(substr({k},1,2)||'.'||substr({k},3,3)||'.'||substr({k},6,3)||'/'||substr({k},9,4)||'-'||substr({k},13,2))"
    )


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def money(value: str) -> str:
    """'R$ 1.234,56' of a decimal(18,2) expression."""
    cents = f"CAST(abs({value}) * 100 AS BIGINT)"
    whole = f"CAST({cents} // 100 AS VARCHAR)"
    grouped = f"reverse(regexp_replace(reverse({whole}), '(\\d{{3}})(?=\\d)', '\\1.', 'g'))"
    grouped = (
        f"CASE WHEN length({whole}) > 6 THEN left({whole}, length({whole})-6)||'.'||substr({whole}, length({whole})-5, 3)||'.'||right({whole}, 3) "
        f"WHEN length({whole}) > 3 THEN left({whole}, length({whole})-3)||'.'||right({whole}, 3) ELSE {whole} END"
    )
    return (
        f"coalesce(CASE WHEN {value} < 0 THEN '-' ELSE '' END || 'R$ ' || {grouped} || ',' || "
        f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'), '')"
    )


def br_date(value: str) -> str:
    return f"coalesce(strftime({value}, '%d/%m/%Y'), '')"


FACTS = f"""
f0 AS ({FACTS_SQL.format(orders='orders')}),
f AS (
  SELECT *,
    CASE WHEN landlord_type='PJ' THEN 'Imobiliária Serra '||contract_id||' LTDA' ELSE 'Helena Moura '||contract_id END AS landlord_name,
    CASE WHEN landlord_type='PJ' THEN {key('contract_id + 500000000000')} ELSE {person('contract_id + 10000000000')} END AS landlord_document,
    CASE WHEN tenant_type='PJ' THEN 'Comércio Alvorada '||customer_id||' LTDA' ELSE 'Pedro Lima '||contract_id END AS tenant_name,
    CASE WHEN tenant_type='PJ' THEN {key('customer_id + 1')} ELSE {person('contract_id + 20000000000')} END AS tenant_document,
    CAST(CAST(rent_cents AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS rent,
    CAST(CAST(start_date + to_months(CAST(term_months AS INTEGER)) AS DATE) - 1 AS DATE) AS end_date
  FROM f0)
"""


def following(start: str, period: str, ref: str) -> str:
    """Smallest start + k * period on or after ref, by trying every k."""
    return (
        f"(CASE WHEN {period} > 0 THEN list_min(list_filter("
        f"[CAST({start} + to_months(CAST(k * {period} AS INTEGER)) AS DATE) for k in range(1, 700)], "
        f"lambda d: d >= {ref})) END)"
    )


NEXT = (
    "CASE WHEN explicit_next = 1 THEN make_date(next_year, next_month, 1) "
    f"WHEN layout <> 3 THEN {following('start_date', 'coalesce(period_months, 12)', f'DATE {REF_DATE!r}')} END"
)
AUTOMATIC = "(automatic = 1 OR renewal_kind = 0)"
PENALTY = (
    "CAST(CASE penalty_kind WHEN 0 THEN rent * 3 WHEN 1 THEN rent * CAST(penalty_rents AS INTEGER) END AS DECIMAL(18,2))"
)
GUARANTEES = (
    "CASE guarantee_kind WHEN 0 THEN 'caucao' WHEN 1 THEN 'seguro_fianca' WHEN 2 THEN 'cessao_fiduciaria' "
    "WHEN 3 THEN 'fianca' ELSE 'caucao,fianca' END"
)
PAYER = "CASE iptu_payer WHEN 'locatario' THEN 'Locatário' ELSE 'Locador' END"
EXPENSES = (
    f"concat_ws('; ', 'IPTU: '||{PAYER}, CASE WHEN condo_split=1 THEN 'Condomínio (ordinário): Locatário' END, "
    "CASE WHEN condo_split=1 THEN 'Condomínio (extraordinário): Locador' END, "
    "CASE WHEN fire_insurance=1 THEN 'Seguro-incêndio: Locatário' END)"
)
RENEWAL = "CASE renewal_kind WHEN 0 THEN 'Sim ('||renewal_months||' meses)' WHEN 1 THEN 'Sim' ELSE 'Não' END"
# Fields to review, in alphabetical order, with the condition for each.
REVIEW = (
    ("carencia_meses", "grace_in_days = 1"),
    ("data_fim_vigencia", "layout = 3"),
    ("data_inicio_vigencia", "layout = 3"),
    ("multa_rescisoria_total", "penalty_kind = 2"),
    ("prorrogacao_automatica", "renewal_kind = 2"),
    ("prorrogacao_prazo_meses", "renewal_kind <> 0"),
    ("reajuste_automatico", f"NOT {AUTOMATIC}"),
    ("reajuste_indice", "adjustment_index IS NULL"),
    ("reajuste_periodicidade", "period_months IS NULL"),
    ("reajuste_proximo", "explicit_next = 0"),
    ("tipo_locacao", "layout = 3"),
)
SURE = (
    "locador", "locadores_adicionais", "locatario", "valor_aluguel", "garantias", "prazo_meses",
    "dia_vencimento_mensal", "reajuste_indice_fonte", "despesas", "flags_juridicas",
)
REVIEW_LIST = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in REVIEW) + ")"
REASON = (
    f"CASE WHEN {REVIEW_LIST} <> '' THEN 'campo(s) extraído(s) com baixa confiança: ' || {REVIEW_LIST} ELSE '' END"
)
ALERTS = (
    "concat_ws(' | ', "
    "CASE WHEN guarantee_kind=4 THEN 'Art. 37: vedada a cumulação de garantias — 2 modalidades detectadas (caucao, fianca).' END, "
    "CASE WHEN adjustment_index='salário mínimo' THEN 'Art. 18: índice de reajuste vedado (''salário mínimo'') — salário mínimo/moeda estrangeira são proibidos.' END, "
    "CASE WHEN period_months<12 THEN 'Art. 18: periodicidade de reajuste inferior a 12 meses ('||period_months||' meses).' END, "
    "CASE WHEN waives=1 THEN 'Cláusula potencialmente abusiva: renúncia a indenização por benfeitorias necessárias (Arts. 35/36).' END, "
    "CASE WHEN cumulates=1 THEN 'Cláusula potencialmente abusiva: cumulação de multas pelo mesmo fato (bis in idem).' END)"
)

D = "DECIMAL(18,2)"
BRACKETS = "br AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, CAST({lo} AS {D}), CAST({'NULL' if hi is None else hi} AS {D}), CAST({rate} AS DECIMAL(6,5)), CAST({ded} AS {D}), "
    + (f"'acima de {lo} — " if hi is None else f"'de {lo} até {hi} — ")
    + f"{float(rate) * 100:g}%', '{rate}')"
    for i, (lo, hi, rate, ded) in enumerate(BRACKETS_2026)
) + ") AS v(n, lo, hi, rate, deduction, bracket, rate_text))"


def bracket_of(base: str) -> str:
    return (
        "CASE " + " ".join(
            f"WHEN {base} <= {hi} THEN {i}" for i, (_, hi, _, _) in enumerate(BRACKETS_2026) if hi
        ) + f" ELSE {len(BRACKETS_2026) - 1} END"
    )


REDUCTION = (
    f"CAST(CASE WHEN rent <= 5000 THEN 312.89 WHEN rent <= 7350 THEN round(greatest(0, 978.62 - CAST(0.133145 AS DECIMAL(7,6)) * rent), 2) "
    f"ELSE 0 END AS {D})"
)
TAX = f"""
t0 AS (SELECT *, CASE WHEN contract_id % 13 <> 0 THEN landlord_type END AS taxed_type,
         CAST(greatest(0, rent - 607.20) AS {D}) AS pbase, {REDUCTION} AS theory FROM f),
t1 AS (SELECT t0.*, br.rate AS prate, br.deduction AS pded, br.bracket AS pbracket, br.rate_text,
         CAST(round(greatest(0, pbase * br.rate - br.deduction), 2) AS {D}) AS pbefore
       FROM t0 JOIN br ON br.n = {bracket_of('t0.pbase')}),
t2 AS (SELECT *, CAST(greatest(0, pbefore - theory) AS {D}) AS ptax FROM t1),
t AS (SELECT *, CAST(pbefore - ptax AS {D}) AS preduced FROM t2)
"""
# Tax of the ledger: the landlord type comes from the text, so it is never missing.
LEDGER = f"""
{FACTS}, {BRACKETS}, {TAX},
l AS (SELECT *,
  CAST(CASE WHEN landlord_type='PF' THEN ptax ELSE 0 END AS {D}) AS tax_withheld,
  CAST(CASE WHEN landlord_type='PF' THEN preduced ELSE 0 END AS {D}) AS tax_reduction,
  {NEXT} AS next_date, {REVIEW_LIST} AS review_list FROM t)
"""

PORTFOLIO = f"""
p AS (
  SELECT c_custkey + 1 AS portfolio_seq, {key('c_custkey + 1')} AS cnpj,
    'Comércio Alvorada '||c_custkey||' LTDA' AS razao_social, c_custkey % 7 <> 0 AS ativo, c_name AS alias
  FROM customer
  UNION ALL
  SELECT s_suppkey + 1000000000, {key('s_suppkey + 900000000000')}, 'Fornecedora Litoral '||s_suppkey||' SA', true, s_name
  FROM supplier)
"""
LINKS = f"""
{FACTS}, {PORTFOLIO},
k AS (SELECT f.contract_id, tenant_name, tenant_document, p.cnpj,
  CASE WHEN p.cnpj IS NULL THEN 'NAO_ENCONTRADO' ELSE 'ENCONTRADO' END AS status,
  CASE WHEN p.cnpj IS NULL THEN 'nenhum' ELSE 'cnpj' END AS method,
  CASE WHEN p.cnpj IS NOT NULL THEN 100.0::DOUBLE END AS score
  FROM f LEFT JOIN p ON p.cnpj = f.tenant_document)
"""
COVERAGE = f"""
{LINKS}, m AS (SELECT cnpj, count(*) AS n FROM k WHERE cnpj IS NOT NULL GROUP BY 1),
cov AS (SELECT p.*, m.n FROM p LEFT JOIN m USING (cnpj))
"""
RAW_KEYS = f"""
r0 AS (SELECT c_custkey, {key('c_custkey + 1')} AS key FROM customer),
r AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN {masked('key')} WHEN 1 THEN '  '||key||chr(9)
   WHEN 2 THEN substr(key,3,12) WHEN 3 THEN 'sem numero' END AS raw FROM r0)
"""
YEARLY = """
y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
yb AS (
  SELECT CAST(y AS VARCHAR) AS version, CAST(0 AS DECIMAL(18,2)) AS lo, CAST(1000 + (y-1990)*10 AS DECIMAL(18,2)) AS hi,
    CAST(0 AS DECIMAL(6,5)) AS rate, CAST(0 AS DECIMAL(18,2)) AS deduction FROM y
  UNION ALL
  SELECT CAST(y AS VARCHAR), CAST(1000 + (y-1990)*10 AS DECIMAL(18,2)), CAST(NULL AS DECIMAL(18,2)),
    CAST(0.1 AS DECIMAL(6,5)), CAST(100 AS DECIMAL(18,2)) FROM y)
"""
HASHED = """
h AS (SELECT doc_id, lang, sha256(text) AS hash, CASE WHEN source='src3' THEN 'ilegível' END AS error FROM documents),
hs AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error'
  WHEN doc_id = min(CASE WHEN error IS NULL THEN doc_id END) OVER (PARTITION BY hash) THEN 'processed'
  ELSE 'duplicate' END AS status FROM h)
"""
SHEETS = f"""
s0 AS (
  SELECT n_name||'.csv' AS source, n_nationkey % 5 AS style, c_custkey + 2 AS "row", c_custkey AS c, n_name,
    {key('c_nationkey * 1000 + c_custkey % 40 + 1')} AS full_key, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
s1 AS (
  SELECT *,
    CASE WHEN c % 19 = 0 THEN '' WHEN c % 17 = 3 THEN '123' WHEN c % 2 = 0 THEN {masked('full_key')} ELSE full_key END AS key_cell,
    CASE WHEN c % 19 = 0 OR c % 13 = 0 THEN '' ELSE 'Firma '||c_mktsegment||' '||c END AS name_cell,
    (style <> 1 AND c % 23 = 0) AS short
  FROM s0),
s AS (SELECT *, CASE WHEN short THEN '' ELSE name_cell END AS name FROM s1)
"""
HEADER_AT = "CASE WHEN n_nationkey % 5 = 3 THEN 1 ELSE 0 END"
# A sheet whose header names no key column needs 60% of key-like cells, else it has no mapping.
OUTCOMES = f"""
{SHEETS},
mapped AS (SELECT source FROM s1 GROUP BY source, style HAVING style <> 2
   OR count(*) FILTER (key_cell NOT IN ('', '123')) >= 0.6 * count(*) FILTER (key_cell <> '')),
v AS (SELECT *, CASE WHEN key_cell NOT IN ('', '123') THEN full_key END AS "key" FROM s WHERE source IN (SELECT source FROM mapped)),
w AS (SELECT *, min(CASE WHEN "key" IS NOT NULL AND name <> '' THEN "row" END) OVER (PARTITION BY source, "key") AS first_row FROM v),
o AS (SELECT *, CASE WHEN key_cell = '' AND name = '' THEN 'blank' WHEN "key" IS NULL THEN 'error'
   WHEN "row" > first_row THEN 'duplicate' WHEN name = '' THEN 'error' ELSE 'imported' END AS status FROM w)
"""
# Row 1 of the sheets with a title line is their header, which is no data row.
CHANGES = f"""
c0 AS (SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'edit' WHEN 'O' THEN 'insert' ELSE 'remove' END AS op,
   CASE WHEN o_orderkey % 37 <> 0 THEN {key('o_custkey * 2 + 1')} END AS cnpj, o_orderkey AS k FROM orders),
c1 AS (SELECT *, CASE WHEN k % 11 = 0 THEN '' WHEN op = 'edit' AND k % 3 = 0 THEN NULL ELSE 'Nome '||k END AS name,
   CASE WHEN k % 4 = 0 THEN false END AS ativo, CASE WHEN k % 10 = 0 THEN '' WHEN k % 5 = 0 THEN 'Apelido '||k||'|Outro' END AS al,
   CASE WHEN k % 7 = 0 THEN 'Fantasia|Loja '||k END AS nf FROM c0),
c2 AS (SELECT *, CASE WHEN cnpj IS NULL THEN 'CNPJ: CNPJ deve ter 14 dígitos; obtido 2 em ''12''.'
   WHEN op <> 'remove' AND name = '' THEN 'Razão Social: String should have at least 1 character' END AS wrong FROM c1),
c3 AS (SELECT *, last_value(CASE WHEN wrong IS NULL THEN CASE op WHEN 'insert' THEN true WHEN 'remove' THEN false END END IGNORE NULLS)
   OVER (PARTITION BY cnpj ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM c2),
c4 AS (SELECT c3.*, p.cnpj IS NOT NULL AS in_base, coalesce(state, p.cnpj IS NOT NULL) AS there FROM c3 LEFT JOIN p USING (cnpj)),
j AS (SELECT *, coalesce(wrong, CASE WHEN op='insert' AND there THEN 'Empresa com CNPJ '||cnpj||' já cadastrada.'
   WHEN op='edit' AND NOT there THEN 'Empresa com CNPJ '||cnpj||' não encontrada.' END) AS reason FROM c4),
jj AS (SELECT *, cnpj IS NOT NULL AND reason IS NULL AND NOT (op='remove' AND NOT there) AS effective FROM j)
"""
APPLIED = f"""
{PORTFOLIO}, {CHANGES},
e AS (SELECT * FROM jj WHERE effective),
rs AS (SELECT cnpj, max(seq) AS rseq, arg_max(op, seq) AS rop FROM e WHERE op <> 'edit' GROUP BY 1),
sn AS (SELECT e.* FROM e LEFT JOIN rs USING (cnpj) WHERE op <> 'remove' AND (rseq IS NULL OR seq >= rseq)),
lt AS (SELECT cnpj, arg_max(name, seq) FILTER (name IS NOT NULL) AS lname, arg_max(ativo, seq) FILTER (ativo IS NOT NULL) AS lativo,
   arg_max(al, seq) FILTER (al IS NOT NULL) AS lal, arg_max(nf, seq) FILTER (nf IS NOT NULL) AS lnf FROM sn GROUP BY 1),
al AS (SELECT coalesce(p.cnpj, rs.cnpj) AS cnpj, p.razao_social, p.ativo, p.portfolio_seq, p.alias, rs.rop, rs.rseq FROM p FULL JOIN rs ON p.cnpj = rs.cnpj)
"""
NEAR_NAME = (
    "(substr(upper(p_brand)||' '||p_type||' '||p_name, 1, CAST(p_partkey % 5 + 2 AS INT)) || "
    "substr(upper(p_brand)||' '||p_type||' '||p_name, CAST(p_partkey % 5 + 4 AS INT), 100))"
)
TENANT_NAME = (
    "CASE WHEN p_partkey % 11 = 0 THEN 'Outra Firma Qualquer '||p_partkey "
    f"WHEN p_partkey % 7 = 0 THEN substr({NEAR_NAME}, 1, 12)||substr('qzwxkvj', 1, CAST(p_partkey % 6 + 2 AS INT))||substr({NEAR_NAME}, 13, 100) "
    f"ELSE {NEAR_NAME} END"
)
COMPARE = "array_to_string(list_sort(list_filter(string_split(lower(replace({}, '#', ' ')), ' '), lambda x: x <> '')), ' ')"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence length by bit rows, one per letter of b."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    masks = (
        f"[list_sum([CASE WHEN substr({a}, CAST(i + 1 AS INT), 1) = ch THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE CAST(0 AS HUGEINT) END "
        f"for i in range(0, length({a}))]) for ch in string_split({b}, '')]"
    )
    state = (
        f"list_reduce(list_prepend({full}, {masks}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})"
    )
    return f"(length({a}) - bit_count({state}))"


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def matches() -> str:
    """CTE mt: the best candidate over all pairs of names, from a score of 80 on.

    Letter counts, a lower bound of the distance, spare the exact measure of hopeless pairs.
    """
    company = "p_name||' '||p_type||' '||p_brand"
    counts = ", ".join(f"length({{0}}) - length(replace({{0}}, '{c}', '')) AS c{i}" for i, c in enumerate(LETTERS))
    apart = " + ".join(f"abs(x.c{i} - y.c{i})" for i in range(len(LETTERS)))
    total = "(length(a) + length(b))"
    return f"""
nt AS (SELECT p_partkey AS contract_id, {TENANT_NAME} AS tenant_name, {COMPARE.format('(' + TENANT_NAME + ')')} AS a FROM part),
nc AS (SELECT p_partkey AS seq, 0 AS pos, {key('p_partkey + 1')} AS cnpj, {COMPARE.format('(' + company + ')')} AS b FROM part
  UNION ALL SELECT p_partkey, 1, {key('p_partkey + 1')}, {COMPARE.format("(p_brand||' '||p_name)")} FROM part),
xa AS (SELECT a, {counts.format('a')} FROM (SELECT DISTINCT a FROM nt)), xb AS (SELECT b, {counts.format('b')} FROM (SELECT DISTINCT b FROM nc)),
xp AS (SELECT a, b FROM xa x JOIN xb y ON ({apart}) <= {total} * 0.2 + 0.000001),
xs AS (SELECT a, b, (1.0::DOUBLE - ({total} - 2 * {lcs('a', 'b')})::DOUBLE / {total}) * 100.0 AS score FROM xp),
xr AS (SELECT a, cnpj, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, seq, pos) AS n FROM xs JOIN nc USING (b) WHERE score >= 80),
mt AS (SELECT contract_id, tenant_name, CASE WHEN score >= 85 THEN cnpj END AS cnpj, CASE WHEN score >= 85 THEN 'ENCONTRADO' ELSE 'NAO_ENCONTRADO' END AS status,
  CASE WHEN score >= 85 THEN 'fuzzy' ELSE 'nenhum' END AS method, round(score, 6) AS score FROM nt LEFT JOIN (SELECT * FROM xr WHERE n = 1) USING (a))
"""


WRITTEN_MONTH = "[" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + "]"


def oracle_sql() -> dict[str, str]:
    conf = "CASE WHEN layout = 2 THEN 0.7 ELSE 0.9 END::DOUBLE"
    has_dates = "CASE WHEN layout = 3 THEN 0.0 WHEN layout = 0 THEN 0.7 ELSE 0.9 END::DOUBLE"
    sql: dict[str, str] = {}

    sql["compliance_ledger"] = f"""WITH {LEDGER}, {PORTFOLIO}
      SELECT contract_id, tenant_name, tenant_document, landlord_name, rent, adjustment_index AS "index",
        CAST(next_date AS VARCHAR) AS adjustment_next, CAST(CASE WHEN layout<>3 THEN end_date END AS VARCHAR) AS due_date,
        tax_withheld, tax_reduction, p.cnpj, CASE WHEN p.cnpj IS NULL THEN 'NAO_ENCONTRADO' ELSE 'ENCONTRADO' END AS status,
        CASE WHEN p.cnpj IS NULL THEN 'nenhum' ELSE 'cnpj' END AS method, review_list <> '' AS needs_review
      FROM l LEFT JOIN p ON p.cnpj = l.tenant_document"""
    sql["contract_parties"] = f"""WITH {FACTS} SELECT contract_id, landlord_type, landlord_name, landlord_document,
      tenant_type, tenant_name, tenant_document, {conf} AS landlord_confidence, {conf} AS tenant_confidence,
      CASE WHEN layout = 2 THEN 'parte em redação narrativa' END AS tenant_detail FROM f"""
    sql["contract_extra_landlords"] = f"""WITH {FACTS} SELECT contract_id, CAST(co_owner AS BIGINT) AS extra,
      CASE WHEN co_owner=1 THEN 'Ana Prado '||contract_id ELSE '' END AS names,
      CASE WHEN co_owner=1 THEN {person('contract_id + 30000000000')} END AS document, 0.9::DOUBLE AS confidence FROM f"""
    sql["contract_rent_penalty"] = f"""WITH {FACTS} SELECT contract_id, rent, 0.9::DOUBLE AS rent_confidence, {PENALTY} AS penalty,
      CASE penalty_kind WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.0 END::DOUBLE AS penalty_confidence,
      CASE WHEN penalty_kind < 2 THEN 'regra' ELSE 'nao_encontrado' END AS penalty_origin,
      CASE penalty_kind WHEN 1 THEN penalty_rents||' aluguéis × valor base' WHEN 2 THEN 'multa rescisória não localizada' END AS penalty_detail FROM f"""
    sql["contract_guarantees"] = f"WITH {FACTS} SELECT contract_id, {GUARANTEES} AS guarantees, 0.9::DOUBLE AS confidence FROM f"
    sql["contract_term_dates"] = f"""WITH {FACTS} SELECT contract_id,
      CASE WHEN layout<>3 THEN CAST(start_date AS VARCHAR) END AS start_date, CASE WHEN layout<>3 THEN CAST(end_date AS VARCHAR) END AS end_date,
      {big('term_months', 'due_day', 'grace_months')}, {has_dates} AS start_date_confidence, {has_dates} AS end_date_confidence,
      0.9::DOUBLE AS term_months_confidence, 0.9::DOUBLE AS due_day_confidence,
      CASE WHEN grace_in_days=1 THEN 0.0 ELSE 0.9 END::DOUBLE AS grace_months_confidence FROM f"""
    sql["contract_adjustment"] = f"""WITH {FACTS}, g AS (SELECT *, {NEXT} AS nd FROM f)
      SELECT contract_id, adjustment_index, index_source, CAST(period_months AS BIGINT) AS period_months, CAST(nd AS VARCHAR) AS next_date,
      CASE WHEN explicit_next=1 THEN 'regra' WHEN nd IS NOT NULL THEN 'regra_calculada' ELSE 'nao_encontrado' END AS next_origin,
      CASE WHEN explicit_next=1 THEN 0.7 WHEN nd IS NOT NULL THEN 0.45 ELSE 0.0 END::DOUBLE AS next_confidence,
      {AUTOMATIC} AS automatic, CASE WHEN {AUTOMATIC} THEN 0.9 ELSE 0.45 END::DOUBLE AS automatic_confidence FROM g"""
    sql["contract_expenses"] = f"WITH {FACTS} SELECT contract_id, {EXPENSES} AS expenses, 0.9::DOUBLE AS confidence FROM f"
    sql["contract_renewal"] = f"""WITH {FACTS} SELECT contract_id, renewal_kind < 2 AS automatic,
      CAST(CASE WHEN renewal_kind=0 THEN renewal_months END AS BIGINT) AS months, {RENEWAL} AS label,
      CASE WHEN renewal_kind < 2 THEN 0.9 ELSE 0.45 END::DOUBLE AS confidence FROM f"""
    sql["contract_lease_type"] = f"""WITH {FACTS} SELECT contract_id, lease_type AS "value", CASE WHEN layout=3 THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence,
      CASE WHEN layout=3 THEN 'nao_encontrado' ELSE 'regra' END AS origin,
      CASE WHEN layout=3 THEN 'ambíguo e sem interpretador de LLM' ELSE 'tipo pelo título' END AS detail FROM f"""
    sql["ambiguous_routing"] = f"""WITH {FACTS} SELECT contract_id, coalesce(lease_type, 'comercial') AS "value",
      CASE WHEN layout=3 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN layout=3 THEN 'llm' ELSE 'regra' END AS origin,
      CASE WHEN layout=3 THEN 'lido no trecho' ELSE 'tipo pelo título' END AS detail FROM f"""
    sql["own_rule_pack"] = f"""WITH {FACTS}, o AS (SELECT *, grace_months IS NULL AND grace_in_days = 1 AS days FROM f)
      SELECT contract_id, rent, CASE adjustment_index WHEN 'IPCA' THEN 'IPCA (novo)' ELSE adjustment_index END AS adjustment_index,
      CASE WHEN days THEN CAST(45 AS BIGINT) END AS grace_days, CASE WHEN fire_insurance=1 THEN 'sim' END AS fire_cover,
      CASE WHEN NOT days THEN 'carência em dias não localizada' END AS days_detail,
      CASE WHEN fire_insurance=1 THEN 0.8 ELSE 0.0 END::DOUBLE AS cover_confidence, NOT days AS days_to_review FROM o"""
    at = lambda term: f"strpos(lower(text), '{term}')"
    sql["excerpts"] = "SELECT doc_id, CASE " + " ".join(
        f"WHEN {at(t)} > 0 THEN substr(text, CAST(greatest(1, {at(t)} - 100) AS BIGINT), 400)"
        for t in ("destina", "finalidade", "objeto", "imóvel", "imovel")
    ) + " ELSE substr(text, 1, 400) END AS excerpt FROM documents"
    sql["provenance_records"] = f"WITH {FACTS}, u AS (" + " UNION ALL ".join(
        [
            f"SELECT '{n}' AS field, CASE WHEN {c} AND '{n}' NOT IN ('prorrogacao_automatica','reajuste_automatico') "
            + (f"AND layout = 3 " if n == "reajuste_proximo" else "")
            + f"THEN 'nao_encontrado' "
            + ("WHEN explicit_next = 0 THEN 'regra_calculada' " if n == "reajuste_proximo" else "")
            + f"ELSE 'regra' END AS origin, {c} AS review FROM f"
            for n, c in REVIEW
        ]
        + [f"SELECT '{n}', 'regra', false FROM f" for n in SURE]
    ) + ") SELECT field, origin, count(*) AS records, count(*) FILTER (review) AS to_review FROM u GROUP BY 1, 2"
    sql["review_workload"] = f"WITH {FACTS} " + " UNION ALL ".join(
        [f"SELECT '{n}' AS field, count(*) AS documents, count(*) FILTER ({c}) AS to_review FROM f" for n, c in REVIEW]
        + [f"SELECT '{n}', count(*), CAST(0 AS BIGINT) FROM f" for n in SURE]
    )
    sql["review_reasons"] = f"WITH {FACTS} SELECT contract_id, {REVIEW_LIST} <> '' AS needs_review, {REASON} AS review_reason FROM f"
    sql["extraction_accuracy"] = f"""WITH {FACTS}, n AS (SELECT count(*) AS c, count(*) FILTER (contract_id % 50 <> 0) AS r FROM f)
      SELECT 'rent' AS field, c AS documents, r AS agreeing, r / c::DOUBLE AS accuracy FROM n UNION ALL """ + " UNION ALL ".join(
        f"SELECT '{x}', c, c, 1.0::DOUBLE FROM n" for x in (
            "start_date", "end_date", "term_months", "due_day", "adjustment_index", "landlord_type", "landlord_name", "landlord_document",
            "tenant_name", "tenant_document", "lease_type", "index_source", "adjustment_period_months", "grace_months",
        )
    )
    numbers = "CAST([2, 3, 4, 5, 10, 24][CAST(k % 6 + 1 AS INT)] AS BIGINT)"
    sql["clause_values"] = f"""SELECT k AS contract_id, CASE k % 7 WHEN 0 THEN {numbers} WHEN 1 THEN (k % 9 + 1) * 12 WHEN 2 THEN {numbers} * 12 WHEN 3 THEN k % 9 + 1 END AS term_months,
      CASE k % 7 WHEN 0 THEN 0.7 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.45 ELSE 0.0 END::DOUBLE AS confidence,
      CASE WHEN k % 7 = 4 THEN 'moeda estrangeira' END AS "index", CASE WHEN k % 7 = 6 THEN 'comercial' END AS lease_type,
      CASE WHEN k % 7 = 5 THEN 'locador' END AS administration FROM (SELECT o_orderkey AS k FROM orders)"""
    sql["contract_triage"] = f"""WITH {FACTS} SELECT 'contract' AS triage, count(*) AS documents FROM f
      UNION ALL SELECT CASE WHEN length(text) < 400 THEN 'scanned' ELSE 'other' END, count(*) FROM documents GROUP BY 1"""
    sql["document_triage"] = "SELECT CASE WHEN length(text) < 400 THEN 'scanned' ELSE 'other' END AS triage, count(*) AS documents FROM documents GROUP BY 1"
    sql["document_fields"] = "SELECT lang, count(*) AS documents, CAST(0 AS BIGINT) AS landlords, CAST(0 AS BIGINT) AS rents FROM documents GROUP BY 1"
    sql["legal_flags"] = f"""WITH {FACTS} SELECT contract_id, guarantee_kind = 4 AS several_guarantees,
      coalesce(adjustment_index = 'salário mínimo', false) AS forbidden_index, coalesce(period_months < 12, false) AS short_period,
      waives = 1 AS waives_improvements, cumulates = 1 AS cumulates_penalties FROM f"""
    sql["alert_messages"] = f"WITH {FACTS} SELECT contract_id, {ALERTS} AS alerts FROM f"
    sql["clause_flags"] = f"""WITH {FACTS} SELECT contract_id, CAST((guarantee_kind = 4)::INT + coalesce(adjustment_index = 'salário mínimo', false)::INT
      + coalesce(period_months < 12, false)::INT + waives + cumulates AS BIGINT) AS alerts FROM f"""

    sql["key_normalise"] = f"""WITH {RAW_KEYS} SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN key END AS "value",
      CASE c_custkey % 5 WHEN 2 THEN 'CNPJ deve ter 14 dígitos; obtido 12 em '''||raw||'''.' WHEN 3 THEN 'CNPJ sem dígitos: ''sem numero''.'
        WHEN 4 THEN 'CNPJ ausente (None).' END AS reason, c_custkey % 5 < 2 AS looks_like_key,
      CASE c_custkey % 5 WHEN 0 THEN key WHEN 1 THEN key WHEN 2 THEN raw ELSE '' END AS digits FROM r"""
    sql["integer_keys"] = "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS \"value\" FROM customer"
    sql["key_check_digits"] = f"SELECT c_custkey, {check('c_custkey + 1')} AS digits, c_custkey % 3 = 2 AS valid FROM customer"
    sql["header_keys"] = "SELECT conv_id, turn, lower(strip_accents(trim(text, ' '||chr(9)||chr(10)||chr(13)))) AS key FROM conversations"
    sql["name_keys"] = "SELECT p_partkey, lower(p_name||' '||p_type||' '||p_brand) AS key FROM part"
    sql["money_parse"] = f"""WITH {FACTS} SELECT contract_id, CASE WHEN contract_id % 9 <> 0 THEN rent END AS "value", CAST(3 AS BIGINT) AS found,
      CAST(rent * 3 AS {D}) AS second, CAST(50 AS {D}) AS third FROM f"""
    sql["date_parse"] = f"""WITH {FACTS} SELECT contract_id, CAST(CASE contract_id % 6 WHEN 0 THEN start_date WHEN 1 THEN start_date
      WHEN 2 THEN CAST(date_trunc('month', start_date) AS DATE) WHEN 4 THEN make_date(CAST(year(start_date) AS INTEGER), 4, 1) END AS VARCHAR) AS day FROM f"""
    sql["number_words"] = "SELECT p_partkey, CASE WHEN p_partkey % 50 < 40 THEN p_partkey % 50 END AS number FROM part"
    sql["tax_id_detect"] = f"""WITH {FACTS} SELECT contract_id, CASE contract_id % 4 WHEN 0 THEN 'PJ' WHEN 1 THEN 'PF' WHEN 2 THEN 'PJ' END AS type,
      CASE contract_id % 4 WHEN 0 THEN {key('customer_id + 1')} WHEN 1 THEN {person('contract_id + 20000000000')} WHEN 2 THEN {key('customer_id + 1')} END AS document FROM f"""
    sql["party_equivalence"] = f"""WITH {FACTS} SELECT contract_id, CASE WHEN contract_id % 2 = 0 AND contract_id % 3 < 2 THEN contract_id % 3 = 0
      ELSE contract_id % 5 <> 0 END AS same FROM f"""
    amount = f"CASE WHEN contract_id % 5 <> 0 THEN CAST(rent * 1000 - 2000000 AS {D}) END"
    sql["display_labels"] = f"""WITH {FACTS}, g AS (SELECT *, {amount} AS am FROM f) SELECT contract_id, {money('am')} AS money,
      CASE WHEN contract_id % 3 <> 0 THEN {br_date('end_date')} ELSE '' END AS day, CASE WHEN automatic=1 THEN 'Sim' ELSE 'Não' END AS yes_no,
      {RENEWAL} AS renewal, coalesce(grace_months||' meses', '') AS grace FROM g"""
    sql["next_adjustment"] = f"""WITH g AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, o_orderkey % 25 - 2 AS pm,
      CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 4000 - 400 AS INTEGER) AS DATE) AS ref FROM orders)
      SELECT o_orderkey, CAST({following('s', 'pm', 'ref')} AS VARCHAR) AS next_date FROM g"""
    sql["clean_lists"] = "SELECT p_partkey, p_name||'|'||p_type||'|'||p_brand AS items FROM part"
    sql["column_quality"] = f"""WITH {RAW_KEYS} SELECT 'raw' AS "column", count(*) FILTER (c_custkey % 5 < 2) AS valid,
      count(*) FILTER (c_custkey % 5 IN (2, 3)) AS invalid, count(*) FILTER (c_custkey % 5 = 4) AS nulls FROM r
      UNION ALL SELECT 'balance', count(*) FILTER (c_custkey % 4 <> 0), count(*) FILTER (c_custkey % 4 = 0), CAST(0 AS BIGINT) FROM r"""
    sql["reject_reasons"] = f"""WITH {RAW_KEYS} SELECT 'raw' AS "column", CASE c_custkey % 5 WHEN 2 THEN 'CNPJ deve ter 14 dígitos; obtido 12 em …'
      WHEN 3 THEN 'CNPJ sem dígitos: …' ELSE 'CNPJ ausente (None).' END AS reason, count(*) AS "rows" FROM r WHERE c_custkey % 5 >= 2 GROUP BY 2"""

    sql["bracket_lookup"] = f"""WITH {FACTS}, {BRACKETS} SELECT contract_id, rent, lo, hi, rate, deduction, bracket
      FROM f JOIN br ON br.n = {bracket_of('f.rent')}"""
    pf, pj = "taxed_type = 'PF'", "taxed_type = 'PJ'"
    pick = lambda a, b, t, n: f"CAST(CASE WHEN {pf} THEN {a} WHEN {pj} THEN {b} END AS {t}) AS {n}"
    sql["tax_withheld"] = f"""WITH {FACTS}, {BRACKETS}, {TAX} SELECT contract_id, {pick('ptax > 0', 'false', 'BOOLEAN', 'withheld')},
      {pick('ptax', '0', D, 'amount')}, {pick('pbase', 'rent', D, 'base')}, {pick('prate', '0', 'DECIMAL(6,5)', 'rate')},
      {pick('pded', '0', D, 'deduction')}, {pick('pbracket', "'não aplicável (locador PJ)'", 'VARCHAR', 'bracket')},
      {pick("'2026'", "'2026'", 'VARCHAR', 'version')}, {pick('pbefore', '0', D, 'before_reduction')}, {pick('preduced', '0', D, 'reduction')},
      {pick('rent', 'rent', D, 'gross')}, {pick('607.20', '0', D, 'simplified_discount')} FROM t"""
    prefix = "'Rendimento bruto de '||rent||', desconto simplificado de 607.20 → base tributável '||pbase||'.'"
    formula = "' IRRF = '||pbase||' × '||rate_text||' − '||pded||' = '"
    sql["tax_notes"] = f"""WITH {FACTS}, {BRACKETS}, {TAX} SELECT contract_id, CASE
      WHEN {pj} THEN 'IRRF não retido: aluguel pago a locador PJ não sofre retenção nesta modalidade (RF04).'
      WHEN {pf} AND prate = 0 THEN {prefix}||' Faixa isenta: IRRF = R$ 0,00.'
      WHEN {pf} AND preduced > 0 THEN {prefix}||{formula}||pbefore||'; reduzido em '||preduced||' pela Lei nº 15.270/2025 → '||ptax||'.'
      WHEN {pf} THEN {prefix}||{formula}||ptax||'.' END AS note FROM t"""
    sql["rent_reduction"] = f"WITH {FACTS} SELECT contract_id, {REDUCTION} AS reduction FROM f"
    sql["bracket_by_year"] = f"""WITH {FACTS}, {YEARLY} SELECT contract_id, version, lo, hi, rate,
      CASE WHEN hi IS NULL THEN 'acima de '||lo||' — 1E+1%' ELSE 'de '||lo||' até '||hi||' — 0%' END AS bracket
      FROM f JOIN yb ON yb.version = CAST(year(start_date) AS VARCHAR) AND ((hi IS NOT NULL AND rent <= hi) OR (hi IS NULL AND rent > lo))"""
    sql["bracket_ranges"] = """WITH o AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS hi FROM orders),
      d AS (SELECT DISTINCT o_orderpriority AS version, hi FROM o),
      t AS (SELECT version, CAST(hi - CASE WHEN CAST(floor(hi) AS BIGINT) % 50 = 0 THEN 5000 ELSE 1 END AS DECIMAL(18,2)) AS lo, hi FROM d WHERE hi % 10 <> 0
        UNION ALL SELECT version, max(hi), NULL FROM d GROUP BY 1),
      r AS (SELECT o_orderkey AS contract_id, CASE WHEN o_custkey % 11 <> 0 THEN o_orderpriority END AS version,
        CAST(CASE WHEN o_custkey % 17 = 0 THEN -hi ELSE hi + (o_custkey % 3 - 1) * 0.01 END AS DECIMAL(18,2)) AS rent FROM o),
      b AS (SELECT contract_id, arg_min({'lo': lo, 'hi': hi}, (lo, hi)) AS b FROM r JOIN t USING (version) WHERE rent >= 0 AND (hi IS NULL OR rent <= hi) GROUP BY 1)
      SELECT contract_id, rent, version, b.lo AS lo, b.hi AS hi, CAST(CAST(floor(b.lo) AS BIGINT) % 7 * 0.01 AS DECIMAL(6,5)) AS rate,
        CAST(floor(b.lo) AS DECIMAL(18,2)) AS deduction, CASE WHEN rent < 0 THEN NEGATIVE END AS reason FROM r LEFT JOIN b USING (contract_id)""".replace("NEGATIVE", f"'{NEGATIVE_BASE}'")
    sql["bracket_problems"] = f"""WITH {YEARLY} SELECT version, lo, 'A última faixa da tabela deve ser aberta (maximo=None).' AS violation FROM yb
      WHERE CAST(version AS INT) % 3 = 1 AND hi IS NULL UNION ALL
      SELECT version, lo, 'Apenas a última faixa pode ter maximo=None.' FROM yb WHERE CAST(version AS INT) % 3 = 2 AND hi IS NOT NULL"""
    sql["latest_brackets"] = f"WITH {YEARLY} SELECT version, lo, hi, rate, deduction FROM yb WHERE version = (SELECT max(version) FROM yb)"
    sql["replaced_brackets"] = f"""WITH {YEARLY} SELECT version, lo, CAST(deduction + CASE WHEN version >= '2000' THEN 5 ELSE 0 END AS {D}) AS deduction FROM yb"""

    sql["content_dedup"] = f"WITH {HASHED} SELECT doc_id, hash, status FROM hs"
    sql["ingest_summary"] = f"""WITH {HASHED} SELECT lang, count(*) AS total, count(*) FILTER (status='processed') AS processed,
      count(*) FILTER (status='duplicate') AS duplicates, count(*) FILTER (status='error') AS errors FROM hs GROUP BY 1"""
    sql["only_new_documents"] = f"""WITH {HASHED}, e AS (SELECT DISTINCT hash FROM h WHERE lang='en')
      SELECT doc_id, e.hash IS NOT NULL AS already_loaded, CASE WHEN e.hash IS NOT NULL THEN 'Contrato já carregado anteriormente (duplicado).' END AS error
      FROM h LEFT JOIN e USING (hash)"""
    sql["text_routing"] = """SELECT conv_id, turn, CASE WHEN role <> 'user' AND length(text) >= 20 THEN text WHEN turn % 4 <> 2 THEN text END AS text,
      CASE WHEN role <> 'user' AND length(text) >= 20 THEN 'nativo' WHEN turn % 4 <> 2 THEN 'ocr' END AS method,
      CASE WHEN NOT (role <> 'user' AND length(text) >= 20) AND turn % 4 = 2 THEN 'Falha no OCR: sem texto' END AS error FROM conversations"""
    sql["word_confidence"] = """SELECT user_id, round(avg("value") FILTER (event_type <> 'error' AND "value" >= 0), 6) AS mean_confidence,
      coalesce(avg("value") FILTER (event_type <> 'error' AND "value" >= 0) < 60, true) AS low_confidence FROM events GROUP BY 1"""

    sql["header_rows"] = f"SELECT n_name||'.csv' AS source, CAST({HEADER_AT} AS BIGINT) AS header_row FROM nation"
    roles = "CAST({} AS BIGINT) AS key_col, CAST({} AS BIGINT) AS name_col"
    sql["column_roles"] = f"""SELECT n_name||'.csv' AS source, CAST({HEADER_AT} AS BIGINT) AS header_row,
      CAST(CASE WHEN n_nationkey % 5 = 1 THEN 1 ELSE 0 END AS BIGINT) AS key_col, CAST(CASE WHEN n_nationkey % 5 = 1 THEN 0 ELSE 1 END AS BIGINT) AS name_col,
      CAST(NULL AS VARCHAR) AS error FROM nation"""
    cells = f"""cells AS (
      SELECT source, style, 0 AS col, CASE WHEN style=1 THEN name_cell ELSE key_cell END AS val FROM s1
      UNION ALL SELECT source, style, 1, CASE WHEN style=1 THEN key_cell ELSE name_cell END FROM s1 WHERE NOT short
      UNION ALL SELECT source, style, 2, CASE WHEN style=2 THEN '4.000' ELSE n_name END FROM s1 WHERE NOT short)"""
    sql["default_header_roles"] = f"""SELECT n_name||'.csv' AS source, CAST(0 AS BIGINT) AS header_row,
      CAST(CASE WHEN n_nationkey % 5 = 1 THEN 1 ELSE 0 END AS BIGINT) AS key_col, CAST(CASE WHEN n_nationkey % 5 = 1 THEN 0
      WHEN n_nationkey % 5 = 3 THEN 2 ELSE 1 END AS BIGINT) AS name_col, CAST(NULL AS VARCHAR) AS error FROM nation"""
    sql["value_profiles"] = f"""WITH {SHEETS}, {cells} SELECT source, CAST(col AS BIGINT) AS col, count(*) FILTER (val <> '') AS filled,
      count(*) FILTER (val <> '' AND length(replace(replace(replace(val,'.',''),'/',''),'-','')) = 14 AND val NOT LIKE 'Firma%' AND col <> 2) AS key_like,
      count(*) FILTER (val LIKE 'Firma%' OR (col = 2 AND val <> '4.000')) AS textual FROM cells GROUP BY 1, 2"""
    sql["sheet_cell_counts"] = f"""WITH {SHEETS}, {cells}, extra AS (SELECT n_name||'.csv' AS source, unnest([0,1,2]) AS col, CASE WHEN n_nationkey % 5 = 3 THEN 2 ELSE 1 END AS n FROM nation),
      allc AS (SELECT source, col, count(*) AS n FROM cells GROUP BY 1, 2 UNION ALL SELECT source, col, n FROM extra)
      SELECT source, CAST(col AS BIGINT) AS col, CAST(sum(n) AS BIGINT) AS cells FROM allc GROUP BY 1, 2"""
    sql["sniffed_delimiters"] = "SELECT n_name||'.csv' AS source, CAST([44, 59, 9][CAST(length(n_name||'.csv') % 3 + 1 AS INT)] AS BIGINT) AS code FROM nation"
    heads = "[['CNPJ','Razão Social','Cidade'],['Empresa','Nº do CNPJ','Cidade'],['Documento','Cliente','Cidade'],['MAPA DE ALUGUÉIS','',''],['  cnpj ','RAZAO SOCIAL / NOME EMPRESARIAL','Cidade']]"
    sql["delimited_rows"] = f"""WITH {SHEETS} SELECT source, "row", CASE WHEN style=1 THEN name_cell||'|'||key_cell||'|'||n_name WHEN short THEN key_cell
        ELSE key_cell||'|'||name_cell||'|'||CASE WHEN style=2 THEN '4.000' ELSE n_name END END AS cells FROM s1
      UNION ALL SELECT n_name||'.csv', CAST(0 AS BIGINT), array_to_string({heads}[CAST(n_nationkey % 5 + 1 AS INT)], '|') FROM nation
      UNION ALL SELECT n_name||'.csv', CAST(1 AS BIGINT), 'CNPJ|Nome|Cidade' FROM nation WHERE n_nationkey % 5 = 3"""
    sql["import_outcomes"] = f"""WITH {OUTCOMES} SELECT source, "row" + 1 AS line, "key", name, status,
      CASE WHEN status='error' THEN CASE WHEN "key" IS NOT NULL THEN 'Dados inválidos: Razão Social: String should have at least 1 character'
        WHEN key_cell = '' THEN 'CNPJ inválido: CNPJ sem dígitos: ''''.' ELSE 'CNPJ inválido: CNPJ deve ter 14 dígitos; obtido 3 em ''123''.' END END AS reason FROM o"""
    sql["import_summary"] = f"""WITH {OUTCOMES} SELECT source, count(*) AS total_rows, count(*) FILTER (status='imported') AS imported,
      count(*) FILTER (status='duplicate') AS duplicates, count(*) FILTER (status='error') AS errors FROM o GROUP BY 1"""
    sql["source_profiles"] = f"""WITH z AS (SELECT n_name||'.csv' AS source, n_nationkey % 5 AS style, count(c_custkey) + CASE WHEN n_nationkey % 5 = 3 THEN 2 ELSE 1 END AS "rows",
        count(c_custkey) FILTER (c_custkey + 2 < 20) + CASE WHEN n_nationkey % 5 = 3 THEN 2 ELSE 1 END AS sample_rows
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey)
      SELECT source, "rows", CAST(CASE WHEN style=3 THEN 1 ELSE 0 END AS BIGINT) AS header_row, "rows" - 1 - CASE WHEN style=3 THEN 1 ELSE 0 END AS data_rows, sample_rows,
        CAST(CASE WHEN style=1 THEN 1 ELSE 0 END AS BIGINT) AS key_col, CAST(CASE WHEN style=1 THEN 0 ELSE 1 END AS BIGINT) AS name_col FROM z"""
    sql["suggested_sheet"] = """WITH z AS (SELECT n_name||'.csv' AS source, count(c_custkey) + CASE WHEN n_nationkey % 5 = 3 THEN 2 ELSE 1 END AS n
      FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey) SELECT source FROM z ORDER BY n DESC, source LIMIT 1"""
    sql["record_validation"] = f"""WITH {RAW_KEYS}, q AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN 'CNPJ: CNPJ deve ter 14 dígitos; obtido 12 em '''||raw||'''.'
      WHEN 3 THEN 'CNPJ: CNPJ sem dígitos: ''sem numero''.' WHEN 4 THEN 'CNPJ: CNPJ ausente (None).' END AS a,
      CASE WHEN c_custkey % 4 = 0 THEN 'Razão Social: String should have at least 1 character' END AS b FROM r)
      SELECT c_custkey, nullif(concat_ws('; ', a, b), '') AS reason FROM q"""

    sql["record_faults"] = f"""WITH r AS (SELECT *, c_custkey % 11 AS kind, {key('c_custkey + 1')} AS key FROM customer), f AS (
      SELECT *, CASE kind WHEN 1 THEN 'CNPJ: Field required' WHEN 2 THEN 'cidade: Extra inputs are not permitted'
        WHEN 3 THEN 'CNPJ: Input should be a valid string'
        WHEN 4 THEN 'Razão Social: String should have at least 1 character; aliases.1: Input should be a valid string'
        WHEN 6 THEN 'aliases: Input should be a valid list; ativo: Input should be a valid boolean; created_at: Input should be a valid datetime'
        WHEN 9 THEN 'ativo: Input should be a valid boolean; origem_import: Input should be a valid string; zona: Extra inputs are not permitted'
        WHEN 0 THEN NULL WHEN 5 THEN NULL ELSE 'campo: Input should be a valid dictionary' END AS reason FROM r)
      SELECT c_custkey, reason, CASE WHEN reason IS NULL THEN key END AS cnpj, CASE WHEN reason IS NULL THEN c_name END AS name,
        CASE kind WHEN 0 THEN '' WHEN 5 THEN 'A|B' END AS aliases, CASE kind WHEN 0 THEN true WHEN 5 THEN false END AS ativo FROM f"""

    sql["link_by_key"] = f"WITH {LINKS} SELECT contract_id, cnpj FROM k"
    sql["link_status"] = f"WITH {LINKS} SELECT contract_id, cnpj, status, method, score FROM k"
    sql["company_coverage"] = f"""WITH {COVERAGE} SELECT cnpj, CASE WHEN n IS NULL THEN 'NAO_ENCONTRADO' ELSE 'ENCONTRADO' END AS status,
      CASE WHEN n IS NULL THEN 'nenhum' ELSE 'cnpj' END AS method, CASE WHEN n IS NULL THEN 0.0 ELSE 100.0 END::DOUBLE AS score,
      CAST(coalesce(n, 0) AS BIGINT) AS contracts FROM cov"""
    sql["pendencies"] = f"WITH {COVERAGE} SELECT cnpj, 'Contrato da Empresa '||razao_social||' / '||cnpj||' não encontrado' AS message FROM cov WHERE n IS NULL"
    sql["orphan_contracts"] = f"WITH {LINKS} SELECT contract_id, tenant_name, tenant_document, score AS best_score FROM k WHERE cnpj IS NULL"
    sql["compliance_totals"] = f"""WITH {COVERAGE} SELECT count(*) AS companies, (SELECT count(*) FROM k) AS contracts,
      count(*) FILTER (n IS NOT NULL) AS found, count(*) FILTER (n IS NULL) AS pending FROM cov"""
    sql["name_matching"] = f"WITH {matches()} SELECT contract_id, cnpj, status, method, score FROM mt"
    sql["name_orphans"] = f"WITH {matches()} SELECT contract_id, tenant_name, score AS best_score FROM mt WHERE cnpj IS NULL"
    sql["name_coverage"] = f"""WITH {matches()}, g AS (SELECT cnpj, count(*) AS contracts, max(score) AS score FROM mt WHERE cnpj IS NOT NULL GROUP BY 1)
      SELECT {key('p_partkey + 1')} AS cnpj, CASE WHEN g.cnpj IS NULL THEN 'NAO_ENCONTRADO' ELSE 'ENCONTRADO' END AS status,
      CASE WHEN g.cnpj IS NULL THEN 'nenhum' ELSE 'fuzzy' END AS method, coalesce(score, 0.0) AS score, coalesce(contracts, 0) AS contracts
      FROM part LEFT JOIN g ON g.cnpj = {key('p_partkey + 1')}"""
    ending = "array_to_string(list_slice(string_split(lower({0}), ' '), -2, -1), ' ')"
    sql["own_similarity"] = f"""WITH c AS (SELECT p_partkey AS seq, 0 AS pos, p_name||' '||p_type||' '||p_brand AS b FROM part
        UNION ALL SELECT p_partkey, 1, p_brand||' '||p_name FROM part), q AS (SELECT p_partkey AS contract_id, {TENANT_NAME} AS a FROM part),
      qa AS (SELECT DISTINCT a, {ending.format('a')} AS e FROM q), cb AS (SELECT b, min((seq, pos)) AS owner, any_value({ending.format('b')}) AS e FROM c GROUP BY b),
      s AS (SELECT a, owner, (1.0::DOUBLE - levenshtein(lower(a), lower(b))::DOUBLE / greatest(length(a), length(b))) * 100.0 AS score FROM qa JOIN cb USING (e)),
      w AS (SELECT a, owner, score FROM s WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, owner) = 1)
      SELECT contract_id, CASE WHEN score >= 80 THEN {key('owner[1] + 1')} END AS cnpj, CASE WHEN score >= 80 THEN 'ENCONTRADO' ELSE 'NAO_ENCONTRADO' END AS status,
        CASE WHEN score >= 80 THEN 'fuzzy' ELSE 'nenhum' END AS method, round(score, 6) AS score FROM q LEFT JOIN w USING (a)"""
    sql["compare_keys"] = f"SELECT p_partkey AS contract_id, {COMPARE.format('(' + TENANT_NAME + ')')} AS key FROM part"
    company = "p_name||' '||p_type||' '||p_brand"
    sql["edit_scores"] = f"""WITH q AS (SELECT p_partkey, lower(({TENANT_NAME})) AS a, lower({company}) AS b FROM part)
      SELECT p_partkey AS contract_id, round((1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) * 100.0, 6) AS score FROM q"""
    sql["pair_scores"] = f"""WITH q AS (SELECT p_partkey, {COMPARE.format('(' + TENANT_NAME + ')')} AS a, {COMPARE.format('(' + company + ')')} AS b FROM part)
      SELECT p_partkey AS contract_id, round((1.0::DOUBLE - (length(a) + length(b) - 2 * {lcs('a', 'b')})::DOUBLE / (length(a) + length(b))) * 100.0, 6) AS score FROM q"""

    sql["ledger"] = f"""WITH {LEDGER} SELECT contract_id, tenant_name, tenant_document, landlord_name, rent, adjustment_index AS "index", index_source,
      CAST(next_date AS VARCHAR) AS adjustment_next, {AUTOMATIC} AS adjustment_automatic, renewal_kind < 2 AS renewal_automatic,
      CAST(CASE WHEN layout<>3 THEN end_date END AS VARCHAR) AS due_date, CAST(grace_months AS BIGINT) AS grace_months, tax_withheld, tax_reduction,
      false AS incomplete, review_list <> '' AS needs_review FROM l"""
    gap = "(contract_id % 11 = 0 OR contract_id % 7 = 0)"
    sql["ledger_gaps"] = f"""WITH {LEDGER} SELECT contract_id, {gap} AS incomplete, {gap} OR review_list <> '' AS needs_review, {gap} AS says_incomplete FROM l"""
    sql["ledger_without_empty_rows"] = f"WITH {LEDGER} SELECT contract_id, tenant_name, CASE WHEN contract_id % 7 <> 0 THEN rent END AS rent FROM l WHERE contract_id % 11 <> 0"
    sql["ledger_totals"] = f"""WITH {LEDGER} SELECT count(*) AS contracts, CAST(sum(tax_withheld) AS DECIMAL(28,2)) AS total_tax,
      CAST(sum(tax_reduction) AS DECIMAL(28,2)) AS total_reduction FROM l"""
    sql["ledger_filter"] = f"""WITH {LEDGER} SELECT contract_id, tenant_name, adjustment_index AS "index" FROM l
      WHERE adjustment_index = 'IPCA' AND {AUTOMATIC} AND (tenant_type = 'PJ' AND CAST(customer_id AS VARCHAR) LIKE '1%')"""
    sql["index_values"] = f"WITH {FACTS} SELECT DISTINCT adjustment_index AS \"index\" FROM f WHERE adjustment_index IS NOT NULL"
    sql["ledger_display"] = f"""WITH {LEDGER} SELECT contract_id, tenant_name AS d_tenant, tenant_document AS d_tenant_document, landlord_name AS d_landlord,
      {money('rent')} AS d_rent, {money('tax_withheld')} AS d_tax, {money('tax_reduction')} AS d_reduction, coalesce(adjustment_index, '') AS d_index,
      coalesce(index_source, '') AS d_index_source, coalesce(CAST(next_date AS VARCHAR), '') AS d_adjustment_next,
      CASE WHEN {AUTOMATIC} THEN 'Sim' ELSE 'Não' END AS d_adjustment_automatic, CASE WHEN layout<>3 THEN {br_date('end_date')} ELSE '' END AS d_due,
      coalesce(grace_months||' meses', '') AS d_grace, {EXPENSES} AS d_expenses, {RENEWAL} AS d_renewal,
      CASE WHEN co_owner=1 THEN 'Ana Prado '||contract_id ELSE '' END AS d_extra_landlords FROM l"""
    before, shown = sql["ledger_display"].split(" SELECT contract_id, tenant_name AS d_tenant,", 1)
    titles = ", ".join(f'd_{name} AS "{title}"' for name, title in HEADERS)
    total = {"tenant": "'TOTAL'", "tax": money("a"), "reduction": money("b")}
    totals = ", ".join(total.get(name, "''") for name, _ in HEADERS)
    sql["report_sheet"] = f"""{before}, dd AS (SELECT contract_id, tenant_name AS d_tenant,{shown}), z AS (SELECT CAST(sum(tax_withheld) AS {D}) AS a, CAST(sum(tax_reduction) AS {D}) AS b FROM l)
      SELECT CAST(0 AS BIGINT) AS section, contract_id, {titles} FROM dd UNION ALL SELECT 1, NULL, {totals} FROM z"""
    sql["compliance_sheet"] = f"""WITH {COVERAGE}, z AS (SELECT count(*) AS a, (SELECT count(*) FROM k) AS b, count(*) FILTER (n IS NOT NULL) AS c, count(*) FILTER (n IS NULL) AS d FROM cov)
      SELECT CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS position, 'Empresas cadastradas' AS label, CAST(a AS VARCHAR) AS "value" FROM z
      UNION ALL SELECT 0, 1, 'Contratos localizados', CAST(b AS VARCHAR) FROM z UNION ALL SELECT 0, 2, 'Empresas com contrato', CAST(c AS VARCHAR) FROM z
      UNION ALL SELECT 0, 3, 'Pendências', CAST(d AS VARCHAR) FROM z
      UNION ALL SELECT 1, portfolio_seq, 'Contrato da Empresa '||razao_social||' / '||cnpj||' não encontrado', NULL FROM cov WHERE n IS NULL
      UNION ALL SELECT 1, 0, 'Nenhuma pendência.', NULL FROM z WHERE d = 0"""

    sql["upsert_portfolio"] = f"""WITH {PORTFOLIO}, i AS (SELECT {key('o_custkey * 2 + 1')} AS cnpj, min(o_orderkey) AS a, max(o_orderkey) AS z FROM orders GROUP BY o_custkey)
      SELECT coalesce(p.cnpj, i.cnpj) AS cnpj, CASE WHEN i.cnpj IS NOT NULL THEN 'Novo Nome '||z ELSE razao_social END AS razao_social,
        CASE WHEN i.cnpj IS NOT NULL THEN true ELSE ativo END AS ativo, CASE WHEN i.cnpj IS NOT NULL THEN 'planilha.csv' ELSE 'carga' END AS origem_import,
        coalesce(p.portfolio_seq, a + 5000000000) AS portfolio_seq, CAST(CASE WHEN i.cnpj IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS aliases,
        CASE WHEN p.cnpj IS NOT NULL THEN '2024-01-01' ELSE '2026-01-01' END AS created_day FROM p FULL JOIN i ON p.cnpj = i.cnpj"""
    sql["imported_portfolio"] = f"""WITH {OUTCOMES}, {PORTFOLIO},
      off AS (SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip
        FROM (SELECT source, max("row" + 1) AS n FROM o GROUP BY source)),
      i0 AS (SELECT "key" AS cnpj, name, o.source, (SELECT max(portfolio_seq) FROM p) + skip + "row" + 1 AS seq FROM o JOIN off USING (source) WHERE status = 'imported'),
      i AS (SELECT cnpj, arg_max(name, seq) AS name, arg_max(source, seq) AS source, min(seq) AS seq FROM i0 GROUP BY cnpj)
      SELECT coalesce(p.cnpj, i.cnpj) AS cnpj, coalesce(i.name, razao_social) AS razao_social, coalesce(i.source, 'carga') AS origem_import,
        CAST(coalesce(p.portfolio_seq, i.seq) AS BIGINT) AS portfolio_seq, CASE WHEN p.cnpj IS NOT NULL THEN '2024-01-01' ELSE '2026-03-03' END AS created_day
      FROM p FULL JOIN i ON p.cnpj = i.cnpj"""
    hash_ = "sha256(CAST(o_orderkey AS VARCHAR))"
    uid = f"sha256({hash_})"
    uuid_ = f"substr({uid},1,8)||'-'||substr({uid},9,4)||'-'||substr({uid},13,4)||'-'||substr({uid},17,4)||'-'||substr({uid},21,12)"
    sql["upsert_history"] = f"""SELECT CASE WHEN o_orderstatus IN ('F','O') THEN 'antigo-arquivo_'||o_orderkey ELSE {uuid_} END AS id,
      'arquivo_'||o_orderkey||CASE WHEN o_orderstatus IN ('O','P') THEN '_v2' ELSE '' END AS file_name, {hash_} AS file_hash,
      o_orderkey % 2 = 0 AS needs_review, strftime(o_orderdate + to_days(CASE WHEN o_orderstatus IN ('O','P') THEN 1 ELSE 0 END), '%Y-%m-%d') AS day FROM orders"""
    sql["history_lookup"] = f"SELECT 'arquivo_'||o_orderkey AS file_name, {hash_} AS file_hash FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)"
    sql["contract_json"] = f"WITH {FACTS} SELECT contract_id, tenant_name, rent, true AS same FROM f"
    sql["bracket_versions"] = f"WITH {YEARLY} SELECT version, lo, rate FROM yb"
    sql["one_bracket_version"] = f"WITH {YEARLY} SELECT version, lo, hi, rate FROM yb WHERE version = (SELECT min(version) FROM yb)"
    sql["document_files"] = """SELECT doc_id, CASE WHEN NOT bad THEN t END AS text, CASE WHEN missing THEN 'Arquivo não encontrado.'
        WHEN bad THEN 'Erro inesperado na extração: o texto não está em UTF-8.' END AS error
      FROM (SELECT doc_id, text||chr(10) AS t, lang <> 'en' AND regexp_matches(text, '[^\\x00-\\x7F]') AS bad, false AS missing FROM documents
        UNION ALL SELECT -1, NULL, true, true)"""
    sql["delimited_files"] = """SELECT folder, c_custkey||'|'||c_name||' & irmã'||CASE WHEN c_custkey % 5 = 0 THEN chr(10)||'filial; "centro", sul' ELSE '' END||'|'||c_nationkey AS cells
      FROM customer, (VALUES ('a'), ('b')) AS t(folder)"""
    sql["history_newest_first"] = f"SELECT 'arquivo_'||o_orderkey AS file_name, {hash_} AS file_hash FROM orders"
    sql["portfolio_by_name"] = f"WITH {PORTFOLIO} SELECT cnpj, razao_social FROM p"
    sql["json_round_trip"] = f"""WITH {FACTS}, {BRACKETS}, {TAX} SELECT contract_id, rent, {pick('ptax', '0', D, 'amount')}, {pick('prate', '0', 'DECIMAL(6,5)', 'rate')} FROM t"""
    sql["judged_changes"] = f"WITH {PORTFOLIO}, {CHANGES} SELECT seq, op, cnpj, reason, effective FROM jj"
    sql["applied_changes"] = f"""WITH {APPLIED} SELECT al.cnpj, CASE WHEN rop = 'insert' THEN lname ELSE coalesce(lname, razao_social) END AS razao_social,
      CASE WHEN rop = 'insert' THEN coalesce(lativo, true) ELSE coalesce(lativo, ativo) END AS ativo,
      CASE WHEN rop = 'insert' THEN 'manual' ELSE 'carga' END AS origem_import,
      CASE WHEN rop = 'insert' THEN (SELECT max(portfolio_seq) FROM p) + rseq ELSE portfolio_seq END AS portfolio_seq,
      CASE WHEN rop = 'insert' THEN coalesce(lal, '') ELSE coalesce(lal, alias) END AS aliases, coalesce(lnf, '') AS nomes_fantasia,
      CASE WHEN rop = 'insert' THEN '2026-02-02' ELSE '2024-01-01' END AS created_day
      FROM al LEFT JOIN lt ON al.cnpj = lt.cnpj WHERE rop IS NULL OR rop <> 'remove'"""
    sql["bucketed_changes"], sql["bucketed_history"] = sql["applied_changes"], sql["upsert_history"]
    sql["deleted_companies"] = f"""WITH {PORTFOLIO}, g AS (SELECT DISTINCT {key('s_suppkey * 3 + 1')} AS cnpj FROM supplier)
      SELECT count(*) FILTER (g.cnpj IS NULL) AS kept, count(*) FILTER (g.cnpj IS NOT NULL) AS deleted FROM p LEFT JOIN g ON p.cnpj = g.cnpj"""
    sql["truncated_portfolio"] = f"WITH {PORTFOLIO} SELECT CAST(0 AS BIGINT) AS kept, count(*) AS deleted FROM p"
    months = "coalesce(period_months, 12)"
    aging = f"""a AS (SELECT contract_id, CASE WHEN contract_id % 5 <> 0 THEN start_date END AS s, {months} AS pm,
      {following('start_date', months, "DATE '2024-01-01'")} AS old, contract_id % 3 <> 0 AS calc FROM f),
      b AS (SELECT *, CASE WHEN calc AND s IS NOT NULL THEN {following('s', 'pm', f"DATE '{REF_DATE}'")} END AS fresh FROM a)"""
    sql["refreshed_dates"] = f"""WITH {FACTS}, {aging} SELECT contract_id, CAST(coalesce(fresh, old) AS VARCHAR) AS adjustment_next,
      fresh IS NOT NULL AND fresh <> old AS refreshed FROM b"""
    sql["refreshed_count"] = f"WITH {FACTS}, {aging} SELECT count(*) FILTER (fresh IS NOT NULL AND fresh <> old) AS refreshed FROM b"
    later = following("start_date", months, "DATE '2027-10-06'")
    sql["stored_contract_refresh"] = f"""WITH {FACTS}, g AS (SELECT *, {NEXT} AS nd, CASE WHEN explicit_next=0 AND layout<>3 THEN {later} END AS fresh FROM f)
      SELECT contract_id, CAST(coalesce(fresh, nd) AS VARCHAR) AS adjustment_next, coalesce(fresh <> nd, false) AS refreshed FROM g"""
    sql["reject_union"] = f"""WITH {OUTCOMES}, {PORTFOLIO}, {CHANGES.replace('j AS (', 'j AS (')} SELECT 'import' AS stage, count(*) AS rejects FROM o WHERE status='error'
      UNION ALL SELECT 'changes', count(*) FROM jj WHERE reason IS NOT NULL"""
    sql["stream_dedup"] = """SELECT user_id||'/'||event_type AS hash, arg_min(event_id, (ts, event_id)) AS event_id,
      epoch_us(CAST(min(ts) AS TIMESTAMP)) AS ts FROM events GROUP BY ALL"""
    sql["stream_history"] = f"""WITH {FACTS} SELECT 'contrato_'||lpad(CAST(contract_id AS VARCHAR), 9, '0')||'.txt' AS file_name,
      {REVIEW_LIST} <> '' AS needs_review, rent, tenant_document FROM f"""
    sql["stream_links_versions"] = f"""WITH {LINKS}, a AS (SELECT contract_id, p.portfolio_seq % 3 <> 0 AS one, p.portfolio_seq % 5 <> 1 AS two, p.cnpj
        FROM f LEFT JOIN p ON p.cnpj = f.tenant_document),
      b AS (SELECT contract_id, coalesce(one, false) AS one, coalesce(two, false) AS two, cnpj FROM a)
      SELECT contract_id, CASE WHEN two THEN cnpj END AS cnpj, CASE WHEN two THEN 'ENCONTRADO' ELSE 'NAO_ENCONTRADO' END AS status,
        CASE WHEN two THEN 'cnpj' ELSE 'nenhum' END AS method, CASE WHEN two THEN 100.0 ELSE 0.0 END::DOUBLE AS score,
        CAST(CASE WHEN contract_id % 2 = 0 AND one = two THEN 1 ELSE 2 END AS BIGINT) AS portfolio_version FROM b"""
    sql["stream_links"] = f"WITH {LINKS} SELECT contract_id, cnpj, status, method, score FROM k"
    return sql
