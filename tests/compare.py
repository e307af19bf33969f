"""Run registered queries against their oracle SQL: python tests/compare.py [pattern] [sf]."""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def kind(t: pa.DataType) -> str:
    for label, test in (
        ("bool", pa.types.is_boolean),
        ("int", pa.types.is_integer),
        ("float", pa.types.is_floating),
        ("decimal", pa.types.is_decimal),
        ("date", pa.types.is_date),
        ("ts", pa.types.is_timestamp),
        ("str", lambda x: pa.types.is_string(x) or pa.types.is_large_string(x)),
    ):
        if test(t):
            return f"{label}{t.bit_width}" if label == "int" else label
    return str(t)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(table: pa.Table, cols: list[str]) -> list[tuple]:
    data = table.select(cols).to_pylist()
    return sorted((tuple(r[c] for c in cols) for r in data), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    cols = sorted(spark_table.column_names)
    if cols != sorted(duck_table.column_names):
        return f"columns {cols} vs {sorted(duck_table.column_names)}"
    for c in cols:
        a, b = kind(spark_table.schema.field(c).type), kind(duck_table.schema.field(c).type)
        if a != b and b != "null" and not (b == "int32" and spark_table.num_rows == 0):
            return f"type of {c}: {a} vs {b}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} vs {duck_table.num_rows}"
    ra, rb = rows_of(spark_table, cols), rows_of(duck_table, cols)
    bad = []
    for x, y in zip(ra, rb):
        for c, u, v in zip(cols, x, y):
            if hasattr(u, "tzinfo") and u is not None and getattr(u, "tzinfo", None) is not None:
                u = u.replace(tzinfo=None)
            if u != v and not (u != u and v != v):
                bad.append((c, u, v, x, y))
    if bad:
        return f"{len(bad)} cells differ, first: {bad[0][0]}: {bad[0][1]!r} vs {bad[0][2]!r}\n    spark {bad[0][3]}\n    duck  {bad[0][4]}"
    return None


def main(pattern: str = ".", sf: str = "sf0.01") -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidewatch.session import local_session

    spark = local_session("8")
    sf_dir = f"/root/testdata/{sf}"
    con = duck(sf_dir)
    qs, sqls, failed = queries(), oracle_sql(), 0
    for name in qs:
        if not re.search(pattern, name):
            continue
        t0 = time.time()
        try:
            got = qs[name](spark, sf_dir).toArrow()
            t1 = time.time()
            if name in sqls:
                want = con.execute(sqls[name]).to_arrow_table()
                problem = compare(got, want)
                note = f"duck {time.time() - t1:.1f}s"
            else:
                problem, note = None, "no oracle"
        except Exception as e:  # report and go on with the next query
            problem, t1, note = f"{type(e).__name__}: {str(e)[:900]}", time.time(), ""
            got = None
        n = got.num_rows if got is not None else "-"
        status = "ok  " if problem is None else "FAIL"
        print(f"{status} {name:38s} rows={n} spark {t1 - t0:.1f}s {note}" + (f"\n  {problem}" if problem else ""), flush=True)
        if problem is None and n == 0:
            print("     warning: no rows")
        failed += problem is not None
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
