"""Run registered queries on Spark and their SQL on DuckDB and compare all rows.

    python tools/compare.py SF_DIR [MODULE or QUERY ...]
"""

from __future__ import annotations

import glob
import importlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def kind(value) -> str:
    return type(value).__name__


def differences(spark_df, con, sql: str) -> str | None:
    got = spark_df.collect()
    names = sorted(spark_df.columns)
    cursor = con.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(sql_names) != names:
        return f"columns {names} against {sorted(sql_names)}"
    a = sorted((tuple(plain(r[c]) for c in names) for r in got), key=repr)
    at = [sql_names.index(c) for c in names]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} against {len(b)}"
    for x, y in zip(a, b):
        if x != y or [kind(v) for v in x] != [kind(v) for v in y]:
            return f"first difference {x} against {y}"
    return None if a else "no rows on either side"


def main() -> int:
    from leaksift import build_session
    from leaksift.queries.base import Registry  # noqa: F401

    sf, wanted = sys.argv[1], sys.argv[2:]
    modules = [w for w in wanted if os.path.exists(f"leaksift/queries/{w}.py")] or None
    if modules:
        loaded = [importlib.import_module(f"leaksift.queries.{m}") for m in modules]
        queries = {k: v for m in loaded for k, v in m.QUERIES.items()}
        sql = {k: v for m in loaded for k, v in m.SQL.items()}
    else:
        from leaksift.queries.catalog import all_queries, all_sql
        queries, sql = all_queries(), all_sql()
    names = [n for n in queries if modules or not wanted or n in wanted]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in names:
        started = time.time()
        try:
            df = queries[name](spark, sf)
            if name in sql:
                result = differences(df, con, sql[name]) or "ok"
            else:
                result = f"ok (rows only: {df.count()})"
        except Exception as error:  # report and go on
            result = f"error {str(error)[:600]}"
        failed += not result.startswith("ok")
        print(f"{time.time() - started:6.1f}s {name}: {result}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
