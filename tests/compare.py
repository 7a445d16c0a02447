"""Run queries and their SQL twins side by side: `python tests/compare.py [sf_dir] [name …]`."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v if isinstance(v, (bool, int, type(None))) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_cell(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql) -> str | None:
    """None where both sides agree, else a description of the difference."""
    df = fn(spark, sf_dir)
    ours = _rows(df.columns, df.collect())
    if sql is None:
        return None if ours else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = _rows(names, cur.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, first {sorted(df.columns)}: {different[0]}"
    return None if ours else "both empty"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conftest import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con = session(), oracle_connection(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, fn, oracle.get(name))
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.1f}s {'' if name in oracle else '(rows only) '}{problem or 'ok'}", flush=True)
    print("failed:", bad)
