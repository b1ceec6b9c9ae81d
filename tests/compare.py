"""Run a registered query and its check side by side (development helper)."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if hasattr(v, "as_tuple"):
        return repr(round(float(v), 6))
    return str(v)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in cur.fetchall()]
    return [columns[i] for i in order], sorted(rows)


def difference(df, con, sql: str) -> str | None:
    """A short description of the first difference, or None."""
    n1, r1 = rows_of_spark(df)
    n2, r2 = rows_of_sql(con, sql)
    if n1 != n2:
        return f"columns {n1} != {n2}"
    if len(r1) != len(r2):
        only = set(r1) ^ set(r2)
        return f"rows {len(r1)} != {len(r2)}; e.g. {str(sorted(only)[:2])[:600]}"
    for a, b in zip(r1, r2):
        if a != b:
            return f"{n1}: {str(a)[:400]} != {str(b)[:400]}"
    return None
