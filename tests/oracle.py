"""Compare a registered query with its SQL twin; also a small command line.

    python -m tests.oracle [sf] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

TESTDATA = os.environ.get("MARKWISE_TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value if isinstance(value, str) else str(value)


def compare(df, con, sql: str) -> list[str]:
    """Problems found; an empty list means the two results are equal."""
    got_cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in got_cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != got_cols:
        return [f"columns {got_cols} != {sorted(names)}"]
    pos = [names.index(c) for c in got_cols]
    want = Counter(tuple(plain(r[p]) for p in pos) for r in cur.fetchall())
    problems = []
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, t in df.dtypes:
        if t in kinds and kinds[t] != types[c]:
            problems.append(f"type of {c}: {t} vs {types[c]}")
    if got != want:
        problems.append(
            f"{got_cols}: {sum(got.values())} vs {sum(want.values())} rows; only spark "
            f"{list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]}"
        )
    if not got:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    from markwise.session import build_session

    import __spark_entry__ as contract

    sf = argv[0] if argv else "0.01"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{TESTDATA}/sf{sf}"
    con, sqls, bad = connect(sf_dir), contract.oracle_sql(), 0
    for name, build in contract.queries().items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sqls:
                problems = compare(df, con, sqls[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        note = "" if name in sqls else " (no SQL)"
        print(f"{'FAIL' if problems else 'ok  '} {name}{note} {time.time() - start:.1f}s", *problems, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
