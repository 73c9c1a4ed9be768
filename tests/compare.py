"""Compare registered queries with their SQL.  Run as `python tests/compare.py SF_DIR [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, name, sf_dir):
    """None when the query and its SQL agree, else a short description."""
    from folioflow.queries import ORACLES, QUERIES
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if mine else "no rows"
    rel = con.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    theirs = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{len(mine)} vs {len(theirs)} rows; only spark {sorted(a, key=repr)[:2]}; only sql {sorted(b, key=repr)[:2]}"
    return None if mine else "both empty"


if __name__ == "__main__":
    from folioflow.queries import ORACLES, QUERIES, load_all
    from folioflow.session import local_session
    load_all()
    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    bad = 0
    for n in names or list(QUERIES):
        t = time.time()
        try:
            why = difference(spark, con, n, sf)
        except Exception as e:  # report and go on with the next query
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {n} {time.time() - t:.1f}s {'' if n in ORACLES else '(no sql) '}{why or ''}",
              flush=True)
    print("bad:", bad)
