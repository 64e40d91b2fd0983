"""Run registered queries next to their SQL and compare: python tests/check_oracle.py [sf_dir] [name …]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from qaforge.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 6) + 0.0)
    if isinstance(value, dict):
        return str({k: canonical(v) for k, v in value.items()})
    if hasattr(value, "asDict"):
        return str({k: canonical(v) for k, v in value.asDict().items()})
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def check(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)} rows {spent:.1f}s"
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want, want_names = rows_of(cols, rel.fetchall())
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    if names != want_names:
        return False, f"columns {names} / {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} / {len(want)} rows {spent:.1f}s\n   spark {str(extra)[:700]}\n   sql   {str(missing)[:700]}"
    return bool(got), f"{len(got)} rows {spent:.1f}s {kinds}"


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a] or list(entry.queries())
    spark, con = local_session(8), connect(sf_dir)
    bad = []
    for name in names:
        try:
            ok, note = check(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} good", bad)


if __name__ == "__main__":
    main()
