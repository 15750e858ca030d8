"""Compare registered queries with their SQL on DuckDB.

``python tests/oracle.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _cell(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return _cell(v.asDict())
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, type(x).__name__, str(x)) for x in r))


def compare(df, con, sql: str) -> str | None:
    """``None`` if equal, else what differs."""
    sn, sr = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    dn, dr = _rows([c[0] for c in res.description], res.fetchall())
    if sn != dn:
        return f"columns {sn} != {dn}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, first {sn}: {bad[0][0]} != {bad[0][1]}"
    types = [(n, type(a).__name__, type(b).__name__) for n, a, b in zip(sn, sr[0], dr[0])
             if a is not None and b is not None and type(a) is not type(b)] if sr else []
    return f"types differ {types}" if types else None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tessera.session import build_session

    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    qs, oracle = entry.queries(), entry.oracle_sql()
    for name in names or qs:
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                state = "ok" if problem is None else f"FAIL {problem}"
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
                state = f"rows {n}"
        except Exception as err:  # report every query, do not stop at the first
            problem, state = str(err), f"ERROR {type(err).__name__}: {str(err)[:600]}"
        failed += problem is not None
        spark.catalog.clearCache()
        print(f"{name:28s} {time.time() - t:6.2f}s {state}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
