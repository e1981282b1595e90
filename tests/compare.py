"""Run named queries next to their SQL on DuckDB and compare the values.

Usage: python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, every cell as text, rows sorted."""
    out = pd.DataFrame({c: [_text(v) for v in pdf[c].tolist()] for c in sorted(pdf.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def _text(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return "null"
    if isinstance(v, float):
        return repr(v) if v != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


def difference(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else what differs."""
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(set(spark_pdf.columns) ^ set(sql_pdf.columns))}"
    if len(spark_pdf) != len(sql_pdf):
        return f"rows {len(spark_pdf)} != {len(sql_pdf)}"
    a, b = canonical(spark_pdf), canonical(sql_pdf)
    if a.equals(b):
        return None
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    rows = (a != b).any(axis=1)
    return f"{int(rows.sum())} rows differ in {bad}\n{a[rows].head(3)}\n{b[rows].head(3)}"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from relweave import build_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        "compare",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), oracle_sql(), []
    for name, fn in queries().items():
        if argv and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            problem = difference(got, con.execute(sql[name]).df()) if name in sql else None
        except Exception as e:  # noqa: BLE001
            took, problem = time.time() - start, f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "ok" if problem is None else "FAIL"
        note = "" if name in sql else " (rows only)"
        print(f"{mark:5}{name:35}{took:6.1f}s rows={len(got) if problem is None else '-'}{note}", flush=True)
        if problem:
            failed.append(name)
            print(problem, flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
