"""Tax, linkage, import, deduplication, maintenance and streaming on small tables."""

import random
from decimal import Decimal as D
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from leaselake.operators import brackets as B
from leaselake.operators import linkage as J
from leaselake.operators import maintain as M
from leaselake.operators import portfolio_import as I
from leaselake.operators import skew as K
from leaselake.operators.dedup import batch_summary, dedup_by_content

A, BB, C = "11222333000181", "45566778000109", "99887766000105"


def test_tax(spark):
    cases = [
        ("500.00", "0.00"), ("1000.00", "0.00"), ("5000.00", "0.00"), ("6000.00", "394.54"),
        ("7350.00", "945.54"), ("7800.00", "1069.29"), ("3433.85", "0.00"),
    ]
    df = spark.createDataFrame([(D(r), "PF", D(w)) for r, w in cases] + [(D("5000"), "PJ", D("0")), (D("-1"), "PF", None), (None, "PF", None)],
                               "rent decimal(18,2), kind string, want decimal(18,2)")
    rows = B.withholding_tax(df, "rent", "kind", B.brackets_2026(spark)).collect()
    assert all((r.tax.amount if r.tax else None) == r.want for r in rows)
    by_rent = {(r.rent, r.kind): r for r in rows}
    assert by_rent[D("3433.85"), "PF"].tax.before_reduction == D("29.84")
    assert by_rent[D("5000.00"), "PF"].tax.reduction == D("312.89")
    assert by_rent[D("5000.00"), "PJ"].tax.base == D("5000.00")
    assert by_rent[D("-1.00"), "PF"].tax_reason is not None


def test_range_lookup_is_the_array_lookup(spark):
    rng = random.Random(3)
    money = lambda cents: D(cents) / 100
    # Version "hot" has most brackets and rows; bounds fall as well as rise, so that some brackets hide others.
    table = []
    for version, n in (("hot", 400), ("b", 30), ("c", 3)):
        for _ in range(n):
            hi = rng.choice([None, *[rng.randint(0, 5000)] * 60])
            table.append((version, money(rng.randint(0, 5000)), None if hi is None else money(hi), D(rng.randint(0, 9)) / 10, money(7)))
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "c", "d", None]), rng.choice([None, *[money(rng.randint(-50, 5100))] * 9])) for i in range(1500)]
    rows += [(i, "hot", money(2500)) for i in range(1500, 2500)]
    brackets = spark.createDataFrame(
        table, "version string, lo decimal(18,2), hi decimal(18,2), rate decimal(6,5), deduction decimal(18,2)"
    ).withColumns({"legal_basis": F.lit("x"), "source_url": F.lit("y")})
    rents = spark.createDataFrame(rows, "id int, year string, rent decimal(18,2)")
    want = B.bracket_join(rents, "rent", brackets, "year")
    got = B.bracket_range_join(rents, "rent", brackets, "year", ["id"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert B.bracket_range_join(rents.limit(0), "rent", brackets, "year", ["id"]).count() == 0
    none = B.bracket_range_join(rents, "rent", brackets.limit(0), "year", ["id"])
    assert none.count() == len(rows) and none.where("bracket is not null").count() == 0


def test_lookup_reads_one_row_group(spark, tmp_path):
    import pyarrow.parquet as pq

    from leaselake.sources import tables as TAB

    path, rows = str(tmp_path / "history"), 40_000
    history = spark.range(rows).select(F.sha2(F.col("id").cast("string"), 256).alias("file_hash"), F.uuid().alias("contract"))
    TAB.save_history(history, path, files=2, row_group_bytes=256 << 10)
    metas = [pq.ParquetFile(f).metadata for f in Path(path).glob("*.parquet")]
    sizes = [m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)]
    assert len(sizes) >= 8
    wanted = history.first().file_hash
    for value, found in ((wanted, 1), ("0" * 63 + "x", 0), ("8" + wanted[1:-1] + "y", 0)):
        hit = TAB.history_by_hash(spark.read.parquet(path), value)
        assert "PushedFilters: [IsNotNull(file_hash), EqualTo(file_hash" in hit._jdf.queryExecution().executedPlan().toString()
        out = hit.select("file_hash")
        assert len(out.collect()) == found
        scans = [int(m) for m in _scan_rows(out)]
        assert sum(scans) <= (max(sizes) if found else 0)


def _scan_rows(df):
    """Rows that left the file scans of a query that has been collected."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves, out = plan.collectLeaves(), []
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numOutputRows"):
            out.append(metrics.apply("numOutputRows").value())
    return out


def test_reduction(spark, one):
    values = [D(x) for x in ("0.00", "5000.00", "5000.01", "6000.00", "7350.00", "7350.01")]
    assert one(B.reduction, values, "decimal(18,2)") == [D(x) for x in ("312.89", "312.89", "312.89", "179.75", "0.00", "0.00")]


def companies(spark, rows):
    return spark.createDataFrame(
        [(i, k, n, a, []) for i, (k, n, a) in enumerate(rows)],
        "portfolio_seq long, cnpj string, razao_social string, aliases array<string>, nomes_fantasia array<string>",
    )


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def score(a, b):
    key = lambda s: " ".join(sorted(s.lower().replace("#", " ").split()))
    a, b = key(a), key(b)
    return (1 - (len(a) + len(b) - 2 * common(a, b)) / (len(a) + len(b))) * 100


def test_name_matching_against_brute_force(spark):
    names = ["Alpha Comercio LTDA", "Alfa Comercial Ltda", "Beta Servicos ME", "Zeta Holding SA", "Gama", "Beta Serviços de Limpeza ME", "y" * 150 + " sa"]
    tenants = ["COMERCIO ALPHA ltda", "Beta Servico ME", "zeta holdings sa", "gama", "Coisa", "alfa comercia ltda", "x" * 70 + " sa", "Beta Servicos ME", "y" * 140 + " sb", "Beta Serviç Limp ME", "##"]
    portfolio = companies(spark, [(f"{i:014d}", n, [n + " filial"]) for i, n in enumerate(names)])
    contracts = spark.createDataFrame([(i, t, None) for i, t in enumerate(tenants)], "contract_id long, tenant_name string, tenant_document string")
    for floor in (80.0, 60.0):
        got = {r.contract_id: r for r in J.link_entities(contracts, portfolio, floor=floor).collect()}
        for i, t in enumerate(tenants):
            best, key = 0.0, None
            for j, n in enumerate(names):
                for candidate in (n, n + " filial"):
                    if score(t, candidate) > best:
                        best, key = score(t, candidate), f"{j:014d}"
            hit = best >= 85
            assert got[i].cnpj == (key if hit else None), t
            assert got[i].method == ("fuzzy" if hit else "nenhum")
            assert got[i].score == (pytest.approx(best) if best >= floor else None)


@pytest.mark.parametrize("cell", [7, 4096])
def test_cells_lose_no_candidate(spark, monkeypatch, cell):
    rng = random.Random(11)
    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "ROWS", 5)

    def disturbed(text):
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["", "a", "b", "c"]) + text[at + rng.randint(0, 1):]
        return text

    stems = ["".join(rng.choices("abcd ", k=rng.randint(1, 24))) for _ in range(30)]
    left = sorted({disturbed(rng.choice(stems)) for _ in range(150)} - {""})
    right = sorted({disturbed(rng.choice(stems)) for _ in range(150)} - {""}) + ["é日🙂 ab" * 20]
    left += ["é日🙂 ab" * 19 + "c", "日é"]
    plain = lambda a, b: (1 - (len(a) + len(b) - 2 * common(a, b)) / (len(a) + len(b))) * 100
    table = [[plain(a, b) for b in right] for a in left]
    candidates = spark.createDataFrame([(t, i) for i, t in enumerate(right)], "b string, rank long")
    for floor in (60.0, 90.0):
        pairs = J._met(spark.createDataFrame([(t,) for t in left], "a string"), candidates, floor).collect()
        best = {}
        for r in pairs:
            best[r.a] = max(best.get(r.a, (0, 0)), (round(r.score, 9), -right.index(r.b)))
        want = {a: max((round(s, 9), -j) for j, s in enumerate(row)) for a, row in zip(left, table) if max(row) >= floor}
        assert best == want


def test_few_pairs_are_measured(spark):
    """On the part names, which share a small vocabulary, letter bits refuse nearly all pairs at the default floor."""
    from leaselake.plans import registry as Q

    folder = "/root/testdata/sf0.01"
    if not Path(folder).is_dir():
        pytest.skip("tables not present")
    names = Q.named_tenants(spark, folder).select(J.compare_key(F.col("tenant_name")).alias("a")).distinct()
    candidates = J._unique(J.candidate_names(Q.named_companies(spark, folder))).select("b", "rank")
    met, measured = J.measured_pairs(names, candidates, J.DEFAULT_FLOOR)
    assert met <= names.count() * candidates.count() and 0 < measured < 0.05 * met


def test_own_measure_brings_its_pairs_and_gets_raw_names(spark):
    portfolio = companies(spark, [(A, "Alpha LTDA", []), (BB, "Beta ME", [])])
    contracts = spark.createDataFrame([(1, "BETA", None), (2, "nada", None)], "contract_id long, tenant_name string, tenant_document string")
    same_start = lambda a, b: F.when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 100.0).otherwise(0.0)
    by_start = lambda names, candidates: names.join(candidates, F.substring("a", 1, 1) == F.substring("b", 1, 1))
    got = {r.contract_id: (r.cnpj, r.method) for r in J.link_entities(contracts, portfolio, similarity=same_start, pairs=by_start).collect()}
    assert got == {1: (BB, "fuzzy"), 2: (None, "nenhum")}
    with pytest.raises(ValueError):
        J.link_entities(contracts, portfolio, similarity=same_start)


def test_hot_and_null_keys_do_not_meet(spark):
    """Half of all rows on one key, half of the rest null: none of them takes part in the shuffled join."""
    from leaselake.operators.skew import lookup_join

    rows = spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 4 == 1, F.col("id")).cast("long").alias("k")
    )
    for absent in (False, True):
        right = spark.range(0, 4000, 3 if not absent else 5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).where("k <> 7")
        right = right if absent else right.unionByName(spark.createDataFrame([(7, 14)], "k long, v long"))
        got = {r.id: r.v for r in lookup_join(rows, right, ["k"], ["id"], hot_rows=50).collect()}
        held = {r.k: r.v for r in right.collect()}
        assert got == {r.id: held.get(r.k) for r in rows.collect()}


def test_key_first_then_coverage(spark):
    portfolio = companies(spark, [(A, "Alpha LTDA", []), (BB, "Beta ME", []), (C, "Gamma Holding SA", [])])
    contracts = spark.createDataFrame(
        [(1, "outro nome", "11.222.333/0001-81"), (2, "Beta ME", "12345678901"), (3, None, "98765432000110"), (4, None, A)],
        "contract_id long, tenant_name string, tenant_document string",
    )
    links = J.link_entities(contracts, portfolio)
    got = {r.contract_id: (r.cnpj, r.method, r.score) for r in links.collect()}
    assert got == {1: (A, "cnpj", 100.0), 2: (BB, "fuzzy", 100.0), 3: (None, "nenhum", 0.0), 4: (A, "cnpj", 100.0)}
    assert [r.message for r in J.pendencies(links, portfolio).collect()] == [f"Contrato da Empresa Gamma Holding SA / {C} não encontrado"]
    status = {r.cnpj: (r.status, r.contracts) for r in J.company_status(links, portfolio).collect()}
    assert status == {A: ("ENCONTRADO", 2), BB: ("ENCONTRADO", 1), C: ("NAO_ENCONTRADO", 0)}
    assert tuple(J.compliance_totals(links, portfolio).collect()[0]) == (3, 4, 2, 1)


def test_import_outcomes(spark):
    lines = ["CNPJ,Razão Social", "11222333000181,Alpha", "123,Curto", "11222333000181,Repetida", "45566778000109,", "45566778000109,Beta", "45566778000109,", ",Sem CNPJ", ",", ""]
    rows = spark.createDataFrame([("a.csv", i, l.split(",") if l else []) for i, l in enumerate(lines)], "source string, row long, cells array<string>")
    out = I.import_rows(rows, I.map_columns(rows))
    got = {r.line: (r.status, r.reason) for r in out.collect()}
    assert [got[i][0] for i in range(2, 11)] == ["imported", "error", "duplicate", "error", "imported", "duplicate", "error", "blank", "blank"]
    assert got[3][1].startswith("CNPJ inválido: CNPJ deve ter 14") and got[5][1].startswith("Dados inválidos")
    assert tuple(I.import_summary(out).collect()[0]) == (9, 2, 2, 3)


def test_read_rows(spark, tmp_path):
    from leaselake.sources.delimited import read_rows

    (tmp_path / "a.csv").write_bytes("﻿Empresa;CNPJ\nAção \"x\";1\n\"a;b\";2\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("Razão,CNPJ\nJoão,1\n".encode("latin-1"))
    got = {(r.file_name, r.row): r.cells for r in read_rows(spark, str(tmp_path)).collect()}
    assert got["a.csv", 0] == ["Empresa", "CNPJ"] and got["a.csv", 2] == ["a;b", "2"]
    assert got["b.csv", 0] == ["Razão", "CNPJ"] and got["b.csv", 1] == ["João", "1"]


def test_same_names_in_two_folders_stay_apart(spark, tmp_path):
    from leaselake.sources.delimited import read_rows

    for folder, name in (("s1", "Um"), ("s2", "Dois")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(f"CNPJ,Nome\n1,{name}\n")
    rows = read_rows(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")]).collect()
    assert len({r.source for r in rows}) == 2 and {r.file_name for r in rows} == {"x.csv"}
    assert sorted((r.row, r.cells) for r in rows) == [(0, ["CNPJ", "Nome"])] * 2 + [(1, ["1", "Dois"]), (1, ["1", "Um"])]


def test_quoted_line_breaks_as_the_csv_module_reads_them(spark, tmp_path):
    import csv
    import io

    from leaselake.sources import delimited as S

    rng = random.Random(12)
    texts = ['a,"b\nc",d\n1,2,3\n', '"x ""y""\n\n z",1\n"",2\n', 'a"b,c\nd"e,f\n', '"p\nq\nr","s\nt"\nu,v\n', '"open, not closed\nnext,row\n']
    for _ in range(40):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        for _ in range(rng.randint(1, 6)):
            writer.writerow(["".join(rng.choices('ab", \n', k=rng.randint(1, 6))).strip(" ") or "x" for _ in range(3)])
        texts.append(out.getvalue())
    rows = [
        (f"{i}", n // 2, n, line, ",")
        for i, text in enumerate(texts) for n, line in enumerate(text.removesuffix("\n").split("\n"))
    ]
    df = spark.createDataFrame(rows, "source string, block long, row long, value string, delimiter string")
    got = {}
    for r in S.join_quoted(df).collect():
        got.setdefault(int(r.source), {})[r.row] = r.value
    for i, text in enumerate(texts):
        records = [got[i][n] for n in sorted(got[i])]
        assert sorted(got[i]) == list(range(len(records)))
        want = list(csv.reader(io.StringIO(text.removesuffix("\n"))))
        assert [next(csv.reader(io.StringIO(r)), []) for r in records] == want, text
        assert "\n".join(records) == text.removesuffix("\n")


def test_a_quote_never_closed_gathers_no_file(spark, monkeypatch):
    from leaselake.sources import delimited as S

    monkeypatch.setattr(S, "MAX_CELL_CHARS", 50)
    rows = [("a", n // 10, n, '"open' if n == 3 else f"line {n}", ",") for n in range(100)]
    out = S.join_quoted(spark.createDataFrame(rows, "source string, block long, row long, value string, delimiter string"))
    assert sorted((r.row, r.value) for r in out.collect()) == [(0, "line 0"), (1, "line 1"), (2, "line 2"), (3, "")]


def test_lines_after_an_open_quote_are_given_back_and_the_limit_is_per_cell(spark, monkeypatch):
    from leaselake.sources import delimited as S

    monkeypatch.setattr(S, "MAX_CELL_CHARS", 50)
    shape = "source string, block long, row long, value string"
    texts = {
        "open": [f"line {n}" for n in range(3)] + ['x,"open'] + [f"line {n}" for n in range(4, 100)],
        # Three cells of 33 characters each, line breaks included; then one of 51; then a short one and a plain line.
        "sound": ['"' + "a" * 20, "b" * 12 + '","' + "c" * 20, "d" * 12 + '","' + "e" * 20, "f" * 12 + '"', "p,q",
                  '"' + "g" * 25, "h" * 25 + '"', 'r,"s', 't"', "u,v"],
    }
    rows = [(name, n // 3, n, line) for name, text in texts.items() for n, line in enumerate(text)]
    got = {(r.source, r.row): (r.cells, r.error is not None) for r in S.rows_from_lines(spark.createDataFrame(rows, shape)).collect()}
    assert len(got) == 100 + 6
    assert [got["open", n][1] for n in range(100)] == [False] * 3 + [True] * 97
    assert all(got["open", n][0] == [f"line {n}"] for n in range(100) if n != 3)
    a = ["a" * 20 + "\n" + "b" * 12, "c" * 20 + "\n" + "d" * 12, "e" * 20 + "\n" + "f" * 12]
    assert got["sound", 0] == (a, False) and got["sound", 1] == (["p", "q"], False)
    assert got["sound", 2][1] and got["sound", 3][1] and "g" * 25 in got["sound", 2][0][0]
    assert got["sound", 4] == (["r", "s\nt"], False) and got["sound", 5] == (["u", "v"], False)


def test_header_row_given_by_the_caller(spark):
    lines = [["relatório", ""]] * 14 + [["Nome", "CNPJ"], ["Alpha", A], ["Beta", BB]]
    rows = spark.createDataFrame([(s, i, c) for s in ("a", "b") for i, c in enumerate(lines)], "source string, row long, cells array<string>")
    given = spark.createDataFrame([("a", 14)], "source string, header_row int")
    got = {r.source: (r.header_row, r.key_col, r.name_col) for r in I.map_columns(rows, header_rows=given).collect()}
    assert got["a"] == (14, 1, 0) and got["b"][0] == 0
    assert [r.key for r in I.import_rows(rows, I.map_columns(rows, header_rows=given).where("source = 'a'")).orderBy("line").collect()] == [A, BB]


def test_upsert_gives_one_row_per_key(spark):
    base = spark.createDataFrame([("k1", "old", 1), ("k2", "two", 2)], "cnpj string, razao_social string, portfolio_seq long")
    batch = spark.createDataFrame(
        [("k1", "first", 10), ("k1", "last", 12), ("k3", "new", 11), ("k3", "newer", 13)], "cnpj string, razao_social string, portfolio_seq long"
    )
    got = sorted(tuple(r) for r in M.upsert_portfolio(base, batch).collect())
    assert got == [("k1", "last", 1), ("k2", "two", 2), ("k3", "newer", 11)]
    with pytest.raises(ValueError):
        M.upsert(base, batch, "cnpj", [])


def test_imported_companies_are_numbered_after_stored_ones(spark):
    lines = ["CNPJ,Razão Social", f"{A},Alpha", f"{BB},Beta"]
    rows = spark.createDataFrame([(s, i, l.split(",")) for s in ("a.csv", "b.csv") for i, l in enumerate(lines)], "source string, row long, cells array<string>")
    out = I.import_rows(rows, I.map_columns(rows))
    stored = companies(spark, [(C, "Gamma", [])]).withColumn("portfolio_seq", F.lit(100).cast("long"))
    got = I.imported_companies(out, stored, F.lit("2026-01-02").cast("timestamp")).collect()
    assert sorted((r.origem_import, r.cnpj, r.portfolio_seq) for r in got) == [("a.csv", A, 102), ("a.csv", BB, 103), ("b.csv", A, 105), ("b.csv", BB, 106)]
    assert {str(r.created_at) for r in got} == {"2026-01-02 00:00:00"}


def test_inserted_again_is_created_again(spark):
    base = spark.createDataFrame([(A, "Alpha", [], [], True, "carga", 7, "2020-01-01")],
                                 "cnpj string, razao_social string, aliases array<string>, nomes_fantasia array<string>, ativo boolean, origem_import string, portfolio_seq long, at string")
    base = base.withColumn("created_at", F.col("at").cast("timestamp")).drop("at")
    rows = [(1, "remove", A, None), (2, "insert", A, "Alpha 2"), (3, "insert", BB, "Beta"), (4, "edit", BB, "Beta 2"), (5, "edit", A, "  ")]
    changes = spark.createDataFrame([(*r, None, None, None) for r in rows],
                                    "seq long, op string, cnpj string, razao_social string, aliases array<string>, nomes_fantasia array<string>, ativo boolean")
    judged = M.judge_changes(base, changes)
    got = {r.cnpj: (r.razao_social, r.origem_import, r.portfolio_seq, str(r.created_at)[:10]) for r in M.apply_changes(base, judged, F.lit("2026-02-02").cast("timestamp")).collect()}
    assert got == {A: ("Alpha 2", "manual", 9, "2026-02-02"), BB: ("Beta 2", "manual", 10, "2026-02-02")}


def _shuffles(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines())


def test_change_sets_shuffle_little(spark):
    from leaselake.plans import registry as Q

    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("tables not present")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffles(Q.applied_changes(spark, folder)) <= 7
        assert _shuffles(Q.content_dedup(spark, folder)) <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dedup_with_and_without_further_columns(spark):
    rows = [(i, "h" if i % 3 else f"u{i}", "ruim" if i == 1 else None) for i in range(60)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "id long, hash string, error string")
    want = {r.id: r.status for r in dedup_by_content(df, "hash", ["id"], "error").collect()}
    wide = dedup_by_content(df.withColumn("text", F.lit("t")), "hash", ["id"], "error")
    assert want == {r.id: r.status for r in wide.collect()} and wide.columns == ["id", "hash", "error", "text", "status"]
    assert (want[1], want[2], want[4], want[0]) == ("error", "processed", "duplicate", "processed")
    assert tuple(batch_summary(dedup_by_content(df.where("id < 60"), "hash", ["id"], "error")).collect()[0]) == (60, 21, 38, 1)


def test_running_total_over_ranges(spark):
    rng = random.Random(4)
    rows = [(f"{rng.random()}", rng.choice([None, 1, 5, 70])) for _ in range(300)] + [(None, 4)]
    got = K.running_total(spark.createDataFrame(rows, "k string, n int"), ["k"], "n", "before").collect()
    total, want = 0, set()
    for k, n in sorted(rows, key=lambda r: r[0] or ""):
        want.add((k, n, total))
        total += n or 0
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert K.running_total(spark.createDataFrame([], "k string, n int"), ["k"], "n", "before").count() == 0


def test_running_last_over_segments(spark):
    rows = [(k, i, (i % 7 == 0) if i % 3 == 0 else None) for k in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, seq long, v boolean")
    scan = lambda size: {
        (r.k, r.seq): r.last for r in K.running_last(df, "k", "seq", F.col("v"), F.floor(F.col("seq") / size), "last").collect()
    }
    assert scan(4) == scan(1000)


def test_upsert_keeps_and_overwrites(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, made int, v string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 8, "w")], "k string, made int, v string")
    got = {r.k: (r.made, r.v) for r in M.upsert(base, new, "k", ["v"], ("made",)).collect()}
    assert got == {"a": (1, "x"), "b": (2, "z"), "c": (8, "w")}


def test_versions_survive_an_unfinished_write(spark, tmp_path):
    from leaselake.sources import tables as TAB

    root = str(tmp_path / "t")
    assert TAB.read_version(spark, root) is None
    TAB.save_version(spark.range(3), root)
    TAB.save_version(TAB.read_version(spark, root).union(spark.range(2)), root)
    (tmp_path / "t" / "v=3").mkdir()
    assert TAB.versions(spark, root) == [1, 2] and TAB.read_version(spark, root).count() == 5


def test_compacted_history_reads_the_same(spark, tmp_path):
    from leaselake.streaming import ingest as STREAM

    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    for batch, rows in enumerate([[("h1", "a"), ("h2", "b")], [("h2", "c")], [("h3", "d")]]):
        spark.createDataFrame(rows, "file_hash string, file_name string").write.parquet(f"{old}/batch={batch}")
    rows = lambda root: sorted((r.file_hash, r.file_name) for r in STREAM.read_history(spark, root).collect())
    assert STREAM.compact_history(spark, old, new) == 2
    assert rows(new) == rows(old) == [("h1", "a"), ("h2", "c"), ("h3", "d")]
    spark.createDataFrame([("h1", "z")], "file_hash string, file_name string").write.parquet(f"{new}/batch=3")
    assert rows(new) == [("h1", "z"), ("h2", "c"), ("h3", "d")]


def test_late_events_correct_earlier_ones(spark, tmp_path):
    from leaselake.streaming import ingest as STREAM

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals = [[("a", "2026-01-05"), ("a", "2026-01-04")], [("b", "2020-01-01")], [("a", "2019-01-01"), ("c", "2018-01-01")]]
    for rows in arrivals:
        spark.createDataFrame(rows, "hash string, ts string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("hash string, ts string").parquet(source)
        STREAM.stream_dedup(stream, "hash", ["ts"], out, str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted((r.hash, r.ts) for r in STREAM.first_events(spark, out, "hash", ["ts"]).collect())
    # The event of 2019 came last and corrects the one written first.
    assert got == [("a", "2019-01-01"), ("b", "2020-01-01"), ("c", "2018-01-01")]


def test_dedup_state_writes_news_and_corrections_only(spark, tmp_path):
    from leaselake.streaming import ingest as STREAM

    source, out, order = str(tmp_path / "in"), str(tmp_path / "out"), ["ts", "id"]
    schema = "hash string, ts int, id int, note string"
    arrivals = [
        [("a", 5, 1, "x"), ("a", 5, 2, "y"), (None, 3, 3, None), ("b", 9, 4, "z")],
        [("a", 6, 5, "late"), ("b", 9, 4, "z"), ("b", 9, 9, "tie")],
        [("a", 5, 0, "earlier"), (None, 1, 6, "n"), ("c", 1, 7, None)],
    ]
    provider = spark.conf.get(STREAM.STATE_STORE)
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = STREAM.stream_dedup(stream, "hash", order, out, str(tmp_path / "checkpoint"))
        query.awaitTermination()
    assert spark.conf.get(STREAM.STATE_STORE) == provider
    written = {(r.hash, r.id, r.batch) for r in spark.read.parquet(out).collect()}
    assert written == {("a", 1, 0), (None, 3, 0), ("b", 4, 0), ("a", 0, 2), (None, 6, 2), ("c", 7, 2)}
    got = {(r.hash, r.ts, r.id, r.note) for r in STREAM.first_events(spark, out, "hash", order).collect()}
    assert got == {("a", 5, 0, "earlier"), (None, 1, 6, "n"), ("b", 9, 4, "z"), ("c", 1, 7, None)}
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 4 and state["numRowsUpdated"] == 3
    assert any(name.startswith("rocksdb") for name in state["customMetrics"])


def test_folds_between_batches_of_a_running_history(spark, tmp_path, monkeypatch):
    from leaselake.streaming import ingest as STREAM

    root, base, buckets = str(tmp_path / "history"), str(tmp_path / "base"), 4
    schema = "file_hash string, file_name string, needs_review boolean"

    def arrive(batch, names):
        rows = [(h, f"{h}-{batch}", None) for h in names]
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/batch={batch}")

    def same():
        want = sorted(map(tuple, STREAM.read_history(spark, root).collect()))
        got = sorted(map(tuple, STREAM.read_folded_history(spark, root, base).collect()))
        assert got == want
        return len(got)

    arrive(0, [f"h{i}" for i in range(40)])
    assert same() == 40
    assert STREAM.fold_history(spark, root, base, buckets) == [0, 1, 2, 3]
    files = _files(f"{base}/buckets")
    arrive(1, ["h1"])
    assert same() == 40
    (bucket,) = STREAM.fold_history(spark, root, base, buckets)
    kept = [f for f in files if f.parent.name != f"bucket={bucket}"]
    assert len(kept) == 3 and all(_files(f"{base}/buckets").get(f) == files[f] for f in kept)
    assert STREAM.fold_history(spark, root, base, buckets) == [] and same() == 40
    arrive(2, ["h1", "new"])
    arrive(3, ["h2", "new"])
    arrive(4, [])
    # A fold that breaks off after its buckets were written is done again.
    with monkeypatch.context() as broken:
        broken.setattr(STREAM, "F", SimpleNamespace(**{**vars(F), "lit": lambda v: 1 / 0}))
        with pytest.raises(ZeroDivisionError):
            STREAM.fold_history(spark, root, base, buckets)
    assert same() == 41
    assert STREAM.fold_history(spark, root, base, buckets) and same() == 41
    arrive(5, ["h3"])
    assert same() == 41
    read = STREAM.read_folded_history(spark, root, base)
    assert "Exchange hashpartitioning" not in read._jdf.queryExecution().executedPlan().toString()


def test_records_in_json(spark):
    from leaselake.operators import portfolio_import as I

    lines = {
        '{"cnpj":"11.222.333/0001-81","razao_social":" A "}': None, None: I.NO_RECORD, "": I.NO_RECORD, "[]": I.NO_RECORD, "3": I.NO_RECORD, "{": I.NO_RECORD,
        "{}": "CNPJ: Field required; Razão Social: Field required",
        '{"cnpj":null,"razao_social":7,"aliases":[null,"x"],"ativo":2}':
            "CNPJ: Input should be a valid string; Razão Social: Input should be a valid string; aliases.0: Input should be a valid string; ativo: Input should be a valid boolean",
        '{"z":1,"cnpj":"12","a":2,"razao_social":"A"}': "CNPJ: CNPJ deve ter 14 dígitos; obtido 2 em '12'.; z: Extra inputs are not permitted; a: Extra inputs are not permitted",
        '{"cnpj":"11222333000181","razao_social":"A","created_at":"2026-01-02T03:04:05Z","ativo":"NO","origem_import":null}': None,
    }
    rows = spark.createDataFrame([(i, t, "own") for i, t in enumerate(lines)], "reason int, line string, record string").drop("reason", "record")
    got = I.validate_json(rows).collect()
    assert {r.line: r.reason for r in got} == lines
    assert all((r.record is None) == (r.reason is not None) for r in got)
    first, last = (next(r.record for r in got if r.line == t) for t in (list(lines)[0], list(lines)[-1]))
    assert (first.cnpj, first.razao_social, first.aliases, first.ativo, first.created_at) == ("11222333000181", "A", [], True, None)
    assert last.ativo is False and str(last.created_at).startswith("2026-01-02 03:04:05")
    assert I.validate_json(rows.limit(0)).count() == 0


def _files(root):
    return {f: f.stat().st_mtime_ns for f in Path(root).glob("bucket=*/*.parquet")}


def test_only_changed_buckets_are_written(spark, tmp_path):
    from leaselake.operators import buckets as BU

    root, number = str(tmp_path / "t"), 16
    base = spark.range(400).select(F.col("id").cast("string").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("made"))
    BU.create_buckets(base, root, "k", number)
    before = _files(root)
    assert len(before) == number and BU.read_buckets(spark, root, "k").count() == 400
    changes = spark.createDataFrame([("7", "new", 2), ("7", "newer", 3), ("1000", "added", 2), (None, "lost", 2)], "k string, v string, made int")
    touched = BU.upsert_buckets(spark, root, changes, "k", number, ["made"], ("made",))
    after = _files(root)
    same = {f for f in before if int(f.parent.name.split("=")[1]) not in touched}
    assert 1 <= len(touched) <= 2 and len(same) == number - len(touched)
    # The others keep their files, names and times; the changed ones have new files only.
    assert {f: t for f, t in after.items() if f in same} == {f: before[f] for f in same}
    assert len(after) == number and not (set(after) - same) & set(before)
    got = {r.k: (r.v, r.made) for r in BU.read_buckets(spark, root, "k").collect()}
    assert len(got) == 401 and got["7"] == ("newer", 1) and got["1000"] == ("added", 2) and got["8"] == ("old", 1)
    assert BU.upsert_buckets(spark, root, changes.limit(0), "k", number, ["made"]) == [] and _files(root) == after


def test_a_bucket_that_loses_its_last_key_is_empty(spark, tmp_path):
    from leaselake.operators import buckets as BU

    root = str(tmp_path / "t")
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    BU.create_buckets(base, root, "k", 4)
    with pytest.raises(Exception, match="already exists"):
        BU.create_buckets(base, root, "k", 4)
    keys = spark.createDataFrame([("a",), ("not there",)], "k string")
    assert len(BU.delete_from_buckets(spark, root, keys, "k", 4)) == 1
    assert [tuple(r) for r in BU.read_buckets(spark, root, "k").collect()] == [("b", 2)]
    BU.delete_from_buckets(spark, root, base.select("k"), "k", 4)
    empty = BU.read_buckets(spark, root, "k")
    assert empty.columns == ["k", "v"] and empty.count() == 0
    BU.create_buckets(base.limit(0), str(tmp_path / "none"), "k", 4)
    assert BU.read_buckets(spark, str(tmp_path / "none"), "k").count() == 0
    with pytest.raises(ValueError):
        BU.create_buckets(base.withColumn("bucket", F.lit(1)), str(tmp_path / "clash"), "k", 4)


def test_a_change_set_in_buckets_gives_the_same_table(spark, tmp_path):
    from leaselake.operators import buckets as BU

    base = companies(spark, [(A, "Alpha", ["x"]), (C, "Gamma", [])])
    base = base.withColumns(
        {"ativo": F.lit(True), "created_at": F.lit("2020-01-01").cast("timestamp"), "origem_import": F.lit("carga")}
    )
    rows = [(1, "remove", A, None), (2, "insert", BB, "Beta"), (3, "edit", "12", "x"), (4, "edit", A, "gone"), (5, "insert", C, "Gamma")]
    changes = spark.createDataFrame([(*r, [" n ", "n"], None, None) for r in rows],
                                    "seq long, op string, cnpj string, razao_social string, aliases array<string>, nomes_fantasia array<string>, ativo boolean")
    stamp = F.lit("2026-02-02").cast("timestamp")
    want = M.apply_changes(base, M.judge_changes(base, changes), stamp)
    root = str(tmp_path / "t")
    BU.create_buckets(base, root, "cnpj", 8)
    touched, judged = BU.apply_changes_to_buckets(spark, root, changes, 8, stamp)
    got = BU.read_buckets(spark, root, "cnpj").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(r.effective for r in judged.collect()) == 2 and len(touched) <= 2


def test_links_follow_the_portfolio(spark, tmp_path):
    """Earlier links after a new version are those that linking all contracts with it gives."""
    import random

    from leaselake.sources import tables as TAB
    from leaselake.streaming import ingest as STREAM

    draw = random.Random(5)
    words = ["alfa", "beta", "gama", "delta", "norte", "sul", "comercio", "industria"]
    firm = lambda: " ".join(draw.choices(words, k=3))
    key = lambda i: f"{i:014d}"
    first = [(key(i), firm(), [firm()] if i % 3 == 0 else []) for i in range(40)]
    second = [(k, firm() if i % 7 == 1 else n, a) for i, (k, n, a) in enumerate(first) if i % 5] + [(key(i), firm(), []) for i in range(40, 60)]
    place = lambda rows: companies(spark, rows).withColumn("portfolio_seq", F.col("cnpj").cast("long") * 13 % 61)
    rows = [(i, firm()[: draw.choice([9, 30])] if i % 9 else None, key(draw.randrange(70)) if i % 4 == 0 else None) for i in range(120)]
    schema = "contract_id long, tenant_name string, tenant_document string"
    base = str(tmp_path)
    for part, version in ((rows[:80], first), (rows[80:], second)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{base}/in")
        TAB.save_version(place(version), f"{base}/portfolio")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        STREAM.stream_link_versions(stream, f"{base}/portfolio", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    columns = ["contract_id", "cnpj", "status", "method", "score"]
    want = J.link_entities(spark.createDataFrame(rows, schema), place(second)).select(columns).collect()
    now = STREAM.current_links(spark, f"{base}/out")
    assert sorted(map(tuple, now.select(columns).collect()), key=lambda r: r[0]) == sorted(map(tuple, want), key=lambda r: r[0])
    made = {r.contract_id: r.portfolio_version for r in now.collect()}
    assert {made[i] for i in range(80, 120)} == {2} and {made[i] for i in range(80)} == {1, 2}
    assert spark.read.parquet(f"{base}/out").where("portfolio_version = 1").count() == 80


def test_blocks_of_other_letters_are_refused_as_a_whole(spark, monkeypatch):
    """Names and candidates of equal lengths without a common letter share no cell; near ones still meet."""
    monkeypatch.setattr(J, "CELL", 16)
    left = [f"abcab{chr(97 + i % 3) * 3}{chr(100 + i // 3 % 2) * 2}{'ab'[i % 2]}" + "c" * (i // 6) for i in range(48)]
    right = [f"xyzxy{chr(120 + i % 3) * 3}{chr(117 + i // 3 % 2) * 2}z" + "y" * (i // 6) for i in range(48)]
    names = spark.createDataFrame([(t,) for t in left], "a string")
    candidates = spark.createDataFrame([(t, i) for i, t in enumerate([*right, left[0] + "x"])], "b string, rank long")
    (_, a), (_, b) = J._blocks(names, "a"), J._blocks(candidates, "b")
    cells = J._near(a, b, 80.0).collect()
    assert sum(r.a_rows * r.b_rows for r in cells) == 48 * 49
    assert 0 < sum(r.a_rows * r.b_rows for r in cells if r.near) < 48 * 49 / 3
    got = {r.a: r.b for r in J._met(names, candidates, 80.0).collect()}
    assert left[0] in got and set(got.values()) == {left[0] + "x"}
