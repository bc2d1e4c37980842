"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{v:.9g}"
    if isinstance(v, (bool, int)):
        return f"{float(v):.9g}" if not isinstance(v, bool) else str(v)
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def difference(df, con, sql: str) -> str | None:
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    other = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} against {other[0]}"
    if mine[1] == other[1]:
        return None if mine[1] else "both sides are empty"
    seen_mine, seen_other = set(mine[1]), set(other[1])
    only_mine = [r for r in mine[1] if r not in seen_other][:3]
    only_other = [r for r in other[1] if r not in seen_mine][:3]
    return f"{len(mine[1])} rows against {len(other[1])}; only ours {only_mine}; only SQL {only_other}"
