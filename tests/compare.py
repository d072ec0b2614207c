"""Run registered queries and their SQL twins and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(names: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' when both sides give the same rows, else a short account."""
    df = query(spark, sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_names, want = [d[0] for d in cursor.description], cursor.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return (
        f"rows {len(a)} != {len(b)}, {len(only_a)} and {len(only_b)} differ\n"
        f"      spark {only_a[:2]}\n      sql   {only_b[:2]}"
    )


def main(sf_dir: str, names: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from leaselake.session import local_session, release_work

    spark, con = local_session(), connect(sf_dir)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                account = difference(spark, con, query, sql[name], sf_dir) or "same"
            else:
                account = f"no sql, {query(spark, sf_dir).count()} rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            account = "FAILED " + str(error)[:500].replace("\n", " ")
        print(f"{name:26s} {time.time() - start:6.1f}s {account}", flush=True)
    release_work(spark)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
