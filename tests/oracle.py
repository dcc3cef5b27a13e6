"""Run registered queries against DuckDB on the same tables and compare every value.

    python tests/oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    kinds = [str(table.schema.field(n).type) for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in row) for row in zip(*columns)] if columns else []
    return names, kinds, sorted(rows, key=repr)


def _kind(name: str) -> str:
    for family, members in {
        "int": ("int", "uint"),
        "float": ("float", "double", "halffloat"),
        "str": ("string", "large_string"),
        "decimal": ("decimal",),
    }.items():
        if name.startswith(members):
            return family
    return name


def compare(spark_table, duck_table) -> str | None:
    """None when equal, else what differs."""
    names, kinds, rows = rows_of(spark_table)
    want_names, want_kinds, want = rows_of(duck_table)
    if names != want_names:
        return f"columns {names} != {want_names}"
    for name, a, b in zip(names, kinds, want_kinds):
        if _kind(a) != _kind(b):
            return f"type of {name}: {a} != {b}"
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}"
    for a, b in zip(rows, want):
        if a != b:
            odd = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
            return f"value {odd[:3]} in {a} vs {b}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from wiretally.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toArrow()
            took = time.time() - start
            if name in oracles:
                problem = compare(got, con.execute(oracles[name]).to_arrow_table())
            else:
                problem = None
            note = "" if name in oracles else " (no oracle)"
            if got.num_rows == 0:
                note += " EMPTY"
        except Exception as error:  # noqa: BLE001 - report and go on
            took, got, note = time.time() - start, None, ""
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        status = "FAIL" if problem else "ok"
        failed += bool(problem)
        print(f"{status:4} {name} rows={got.num_rows if got is not None else '-'} {took:.2f}s{note}", flush=True)
        if problem:
            print("     ", problem[:1500], flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
