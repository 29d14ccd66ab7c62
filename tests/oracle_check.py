"""Run registered queries and their SQL side by side and compare whole results.

    python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def compare(spark, db, folder: str, name: str) -> tuple[str, int, float]:
    start = time.time()
    df = queries()[name](spark, folder)
    rows = [tuple(row) for row in df.collect()]
    spent = time.time() - start
    statement = oracle_sql().get(name)
    if statement is None:
        return "rows only", len(rows), spent
    result = db.execute(statement)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", len(rows), spent
    types = {d[0]: str(d[1]) for d in result.description}
    names = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "date": "DATE", "boolean": "BOOLEAN"}
    wrong = {c: (t, types[c]) for c, t in df.dtypes if names.get(t) != types[c]}
    if wrong:
        return f"types {wrong}", len(rows), spent
    want, got = _sorted_rows(columns, result.fetchall()), _sorted_rows(df.columns, rows)
    if want != got:
        miss = [w for w in want if w not in set(got)][:2]
        extra = [g for g in got if g not in set(want)][:2]
        return f"values {len(got)}/{len(want)} missing {miss} extra {extra}", len(rows), spent
    return "ok", len(rows), spent


def main() -> None:
    from tradeweave.session import local_session, remove_written

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session("8", "oracle_check")
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    bad = 0
    for name in names:
        try:
            verdict, n, spent = compare(spark, db, folder, name)
        except Exception as error:  # noqa: BLE001
            verdict, n, spent = f"error {str(error)[:600]}", 0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:34s} {n:8d} {spent:7.2f}s {verdict}", flush=True)
    print("bad:", bad)
    remove_written(spark)
    spark.stop()


if __name__ == "__main__":
    main()
