"""Run every query on Spark and its SQL on DuckDB and compare the results.

``python -m checks.compare [sf_dir] [query ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks import catalog

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in ALL_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


_SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None if Spark and SQL agree in columns, types and rows, else what differs."""
    df = catalog.QUERIES[name](spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLES:
        return None if mine else "no rows"
    result = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    types = {d[0]: str(d[1]) for d in result.description}
    unlike = [(c, t, types[c]) for c, t in df.dtypes if _SQL_TYPES.get(t) != types[c]]
    if unlike:
        return f"types {unlike}"
    if mine == theirs:
        return None if mine else "no rows"
    pairs = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(mine)} rows against {len(theirs)}; first difference {str(pairs[:1])[:1500]}"


def main(argv: list[str]) -> int:
    from newslens.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(catalog.QUERIES)
    spark = build_session("checks", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    con = oracle(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
