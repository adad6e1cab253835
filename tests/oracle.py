"""Run a registered query and its SQL on the same files and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


#: Column types that go by other names in the checker.
TYPE_NAMES = {"TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


def type_differences(spark_df, con, sql: str) -> list[str]:
    """Columns of plain types whose types differ."""
    found = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    out = []
    for name, kind in spark_df.dtypes:
        want = TYPE_NAMES.get(found.get(name), None)
        if want != kind and (want or kind in TYPE_NAMES.values()):
            out.append(f"{name}: {kind} here, {found.get(name)} there")
    return out


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    types = type_differences(spark_df, con, sql)
    if types:
        return f"types differ: {types}"
    left = normal_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    right = normal_rows([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}: {left[1][:2]} / {right[1][:2]}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            wrong = sum(x != y for x, y in zip(left[1], right[1]))
            return f"{wrong} of {len(left[1])} rows differ: {str(a)[:500]} != {str(b)[:500]}"
    return None
