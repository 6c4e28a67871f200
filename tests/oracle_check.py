"""Run registered queries and their SQL counterparts side by side and compare the rows.

    python tests/oracle_check.py [sf] [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from nearfield.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


def connect(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    """``(equal, rows, note)`` of one query."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        # Training-data queries that SQL can't express have brute-force tests in their own folder.
        return name in entry.LLM_QUERIES and len(got[1]) > 0, len(got[1]), "no counterpart"
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return True, len(got[1]), ""
    extra = [r for r in got[1] if r not in set(want[1])][:3]
    missing = [r for r in want[1] if r not in set(got[1])][:3]
    return False, len(got[1]), f"want {len(want[1])} rows; extra {extra}; missing {missing}"


if __name__ == "__main__":
    sf_dir = f"{TESTDATA}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(entry.queries())
    session, connection = local_session(), connect(sf_dir)
    failed = []
    for query in names:
        start = time.time()
        try:
            equal, n, note = compare(session, connection, query, sf_dir)
        except Exception as error:  # report and go on with the next query
            equal, n, note = False, 0, f"{type(error).__name__}: {str(error)[:600]}"
        failed += [] if equal else [query]
        print(f"{'ok  ' if equal else 'FAIL'} {query:32} {n:7} rows {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} equal", failed)
