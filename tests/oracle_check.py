"""Compare a Spark result with a DuckDB result: names, types, rows."""

import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _sortable(row):
    return tuple((value is not None, value) for value in row)


def differences(df, connection, sql: str) -> list[str]:
    """What differs, as text; an empty list means the results agree."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = result.fetchall()
    kinds = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {df.columns} but SQL has {names}"]
    for name, kind in df.dtypes:
        if DUCK_TYPES.get(kinds[name], kinds[name]) != kind:
            problems.append(f"{name}: {kind} but SQL has {kinds[name]}")
    actual = sorted((tuple(row) for row in df.select(*names).collect()), key=_sortable)
    expected = sorted(expected, key=_sortable)
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows but SQL has {len(expected)}")
    else:
        unequal = [
            (a, b)
            for a, b in zip(actual, expected)
            if a != b and not all(
                x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
                for x, y in zip(a, b)
            )
        ]
        if unequal:
            problems.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return problems
