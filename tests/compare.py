"""Run a query and its SQL counterpart on the same tables and compare them as unordered rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


KINDS = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "INTEGER": "int", "BOOLEAN": "boolean"}


def difference(df, con, sql: str) -> str | None:
    """None when names, types and rows agree, else a short description."""
    answer = con.execute(sql)
    sql_columns = [c[0] for c in answer.description]
    sql_types = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in answer.description}
    expected = rows_of(sql_columns, answer.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if actual[0] != expected[0]:
        return f"columns {actual[0]} != {expected[0]}"
    spark_types = dict(df.dtypes)
    wrong = {c: (spark_types[c], sql_types[c]) for c in df.columns if spark_types[c] != sql_types[c]}
    if wrong:
        return f"types {wrong}"
    if len(actual[1]) != len(expected[1]):
        return f"rows {len(actual[1])} != {len(expected[1])}"
    for a, e in zip(actual[1], expected[1]):
        if a != e:
            return f"first difference: {a!r:.600} != {e!r:.600}"
    return None
