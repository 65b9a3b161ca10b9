"""Side-by-side check of registered queries and their SQL, as the tests and trial runs use it."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


_FAMILY = {
    "string": "text", "VARCHAR": "text", "date": "date", "DATE": "date", "boolean": "bool", "BOOLEAN": "bool",
    "double": "double", "DOUBLE": "double", "float": "float", "FLOAT": "float", "bigint": "bigint", "BIGINT": "bigint",
    "int": "int", "INTEGER": "int", "timestamp": "ts", "timestamp_ntz": "ts", "TIMESTAMP": "ts",
}


def compare(spark_df, con, text: str) -> list[str]:
    """Differences between a DataFrame and a query; an empty list means they agree."""
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = _rows(names, cursor.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    for name, kind in spark_df.dtypes:
        if _FAMILY.get(kind, kind) != _FAMILY.get(types[name], types[name]):
            problems.append(f"type of {name}: {kind} != {types[name]}")
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    for mine, theirs in zip(got, expected):
        if mine != theirs:
            problems.append(f"first difference\n   spark {str(mine)[:600]}\n   sql   {str(theirs)[:600]}")
            break
    return problems
