"""Compare registered queries with their SQL in DuckDB.

``python -m storegrain.catalog.compare FOLDER [name ...]``
"""

from __future__ import annotations

import sys
import time

from storegrain.catalog import Query
from storegrain.catalog.views import TABLES


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 9) + 0.0 if isinstance(value, float) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, connection, folder: str, query: Query) -> str | None:
    """None if both sides agree, otherwise what differs."""
    df = query.run(spark, folder)
    columns, ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return None if columns else "no columns"
    cursor = connection.execute(query.sql)
    names, theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if columns != names:
        return f"columns {columns} != {names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    types = {(c, type(a).__name__, type(b).__name__) for x, y in zip(ours, theirs)
             for c, a, b in zip(columns, x, y) if a is not None and b is not None and type(a) is not type(b)}
    if types:
        return f"types {sorted(types)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(different)} of {len(ours)} rows differ, first {different[0]}" if different else None


def main(folder: str, names: list[str]) -> int:
    from storegrain.catalog import load_all
    from storegrain.session import build_session, drop_staged

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(folder), []
    registry = load_all()
    for name in names or registry:
        start = time.time()
        try:
            problem = difference(spark, connection, folder, registry[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql" if registry[name].sql else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
        failed += [name] if problem else []
    print(f"{len(failed)} failed: {failed}")
    drop_staged(spark)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
