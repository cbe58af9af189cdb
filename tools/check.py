"""Compare registered queries with their SQL in DuckDB: names, types, rows and values.

usage: python tools/check.py SF_DIR [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
}


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return x


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, con, sql: str) -> str:
    """Empty text when equal, else what differs."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = sorted(types)
    rows = Counter(tuple(cell(r[n]) for n in names) for r in df.collect())
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {r[0]: r[1] for r in described}
    if sorted(theirs) != names:
        return f"columns {names} vs {sorted(theirs)}"
    bad = {n: (types[n], theirs[n]) for n in names if TYPES.get(types[n], types[n]) != theirs[n]}
    order = [r[0] for r in described]
    index = [order.index(n) for n in names]
    expected = Counter(tuple(cell(r[i]) for i in index) for r in con.execute(sql).fetchall())
    if rows != expected:
        extra, missing = rows - expected, expected - rows
        return f"rows {sum(rows.values())} vs {sum(expected.values())}; only here {list(extra)[:3]}; only there {list(missing)[:3]}"
    return f"types {bad}" if bad else ""


def main() -> int:
    from aerolake.catalog import ORACLES, QUERIES
    from aerolake.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                n = ""
            else:
                n, problem = f" rows={df.count()} (no SQL)", ""
        except Exception as e:  # noqa: BLE001
            n, problem = "", f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.2f}s{n} {problem}", flush=True)
    print(f"{failed} failed of {len(wanted) or len(QUERIES)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
