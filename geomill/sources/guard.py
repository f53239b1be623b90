"""SQL from outside: only queries, and only so many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_only(spark: SparkSession, sql: str, limit: int, **tables: DataFrame) -> DataFrame:
    """Run a query; anything that Spark's parser takes for a command or a write is refused."""
    plain = sql.format(**{k: k for k in tables}) if tables else sql
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(plain)
    kinds, todo = [], [plan]
    while todo:
        p = todo.pop()
        kinds.append(p.getClass().getName())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    bad = [k for k in kinds if any(w in k for w in ("Command", "Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Truncate", "SetCatalog"))]
    if bad:
        raise PermissionError(f"only queries are allowed, not {bad[0].rsplit('.', 1)[-1]}")
    return spark.sql(sql, **tables).limit(limit)
