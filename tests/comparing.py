"""Compare a Spark query with its SQL counterpart, value by value."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    return float(value) + 0.0 if isinstance(value, float) else value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(query, sql: str, spark, folder: str, connection) -> list[str]:
    """Empty when columns and all rows agree."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    if got == expected:
        return []
    extra, missing = list((got - expected).items()), list((expected - got).items())
    note = f"{sum(got.values())} rows against {sum(expected.values())}; sorted columns {sorted(names)}"
    return [note, *[f"only Spark: {str(x)[:400]}" for x in extra[:3]],
            *[f"only SQL:   {str(x)[:400]}" for x in missing[:3]]]
