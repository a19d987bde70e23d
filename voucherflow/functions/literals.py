"""Small fixed tables as inline relations, so the optimizer knows their exact size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_literal(v) for v in value)})" if value else "CAST(array() AS array<string>)"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def fixed_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """Rows written in the program, never data: fixed_table(spark, "a b", [(1, "x")])."""
    names = columns.split()
    if not rows:
        raise ValueError("a fixed table needs rows")
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
