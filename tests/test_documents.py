"""Folder scan, listed files and report sink."""

import hashlib

from pyspark.sql import functions as F

from leaselake.sources import documents as S


def test_scan_folder(spark, tmp_path):
    (tmp_path / "b.TXT").write_text("segundo")
    (tmp_path / "A.txt").write_text("primeiro")
    (tmp_path / "c.pdf").write_text("outro")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("dentro")
    rows = S.scan_documents(spark, str(tmp_path)).orderBy("order_key").collect()
    assert [r.file_name for r in rows] == ["A.txt", "b.TXT"]
    assert rows[0].hash == hashlib.sha256(b"primeiro").hexdigest() and rows[0].text == "primeiro"


def test_listed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("texto")
    (tmp_path / "c.pdf").write_text("outro")
    wanted = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("a.txt", "c.pdf", "nada.txt")], "path string")
    rows = {r.file_name: (r.error, r.text) for r in S.scan_listed(spark, wanted, str(tmp_path)).collect()}
    assert rows == {"a.txt": (None, "texto"), "c.pdf": (S.UNSUPPORTED, None), "nada.txt": (S.FILE_NOT_FOUND, None)}


def test_a_file_that_is_not_utf8_is_an_error_row(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("coração".encode("latin-1"))
    (tmp_path / "b.txt").write_text("bom")
    rows = {r.file_name: (r.text, r.error) for r in S.scan_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": (None, S.NOT_UTF8), "b.txt": ("bom", None)}


def test_listed_files_of_several_folders(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.txt").write_text(folder)
    wanted = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("x/a.txt", "y/a.txt", "y/b.txt")], "path string")
    for rows in (S.scan_listed(spark, wanted, [f"{tmp_path}/x", f"{tmp_path}/y"]), S.scan_listed(spark, wanted, str(tmp_path), recursive=True)):
        got = {r.path.split("/", 2)[-1][-7:]: (r.text, r.error) for r in rows.collect()}
        assert got == {"x/a.txt": ("x", None), "y/a.txt": ("y", None), "y/b.txt": (None, S.FILE_NOT_FOUND)}


def test_work_folders_lie_in_the_named_folder_and_go_when_released(spark):
    import os

    from leaselake import session

    folder = session.work_folder(spark, "trial").rpartition("/")[0]
    assert folder == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    mine, other = session._MADE.pop(spark.sparkContext.applicationId), set(os.listdir(folder))
    table = session.stored(spark.range(3), "trial")
    assert table.count() == 3 and len(os.listdir(folder)) == len(other) + 1
    assert session.release_work(spark) == 1 and set(os.listdir(folder)) == other
    session._MADE[spark.sparkContext.applicationId] = mine


def test_routing(spark):
    df = spark.createDataFrame([("x" * 20, None), ("curto", "texto lido"), ("curto", None)], "text string, scan string")
    rows = S.route_text(df, "text", "scan").select("method", F.col("error").isNull().alias("ok")).collect()
    assert [tuple(r) for r in rows] == [("nativo", True), ("ocr", True), (None, False)]


def test_arriving_files_and_the_written_report(spark, tmp_path):
    from leaselake.operators import report as R
    from leaselake.operators.brackets import brackets_2026
    from leaselake.plans.contracts import analyse, report
    from leaselake.streaming.ingest import stream_documents

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "um.txt").write_text("LOCADOR: Ana Reis, CPF nº 111.444.777-35.\n\nLOCATÁRIO: Loja Um LTDA, CNPJ nº 11.222.333/0001-81.\n\nO aluguel é de R$ 6.000,00.")
    (folder / "ruim.txt").write_bytes("coração".encode("latin-1"))
    stream = stream_documents(spark, str(folder))
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination()
    documents = spark.read.parquet(str(out))
    assert {r.file_name: r.error for r in documents.collect()} == {"um.txt": None, "ruim.txt": S.NOT_UTF8}
    contracts = analyse(documents.where("error is null").select("file_name", "text"), "text", "2026-10-06")
    portfolio = spark.createDataFrame(
        [(1, "11222333000181", "Loja Um LTDA", [], []), (2, "45566778000109", "Beta", [], [])],
        "portfolio_seq long, cnpj string, razao_social string, aliases array<string>, nomes_fantasia array<string>",
    )
    result = report(contracts, portfolio, brackets_2026(spark), "file_name")
    R.write_report(result.ledger, "file_name", result.compliance, result.pendencies, str(tmp_path / "report"))
    sheet = spark.read.option("header", "true").csv(str(tmp_path / "report" / "contratos")).collect()
    assert [len(r) for r in sheet] == [15, 15] and sheet[0][0] == "Loja Um LTDA" and sheet[1][0] == R.TOTAL
    assert sheet[0]["IRRF Retido"] == sheet[1]["IRRF Retido"] == "R$ 394,54"
    lines = spark.read.option("header", "true").csv(str(tmp_path / "report" / "conformidade")).collect()
    assert len(lines) == 5 and "Beta" in lines[4]["label"]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Listing many folders does not start a task for each; the session's setting stays as it was."""
    for i in range(150):
        (tmp_path / f"n{i}").mkdir()
        (tmp_path / f"n{i}" / "a.txt").write_text(f"texto {i}")
    tracker, before = spark.sparkContext.statusTracker(), spark.conf.get(S.LISTING_TASKS, None)
    spark.sparkContext.setJobGroup("listing", "listing")
    rows = S.scan_documents(spark, str(tmp_path), recursive=True)
    jobs = tracker.getJobIdsForGroup("listing")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 64
    assert spark.conf.get(S.LISTING_TASKS, None) == before
    assert rows.count() == 150
