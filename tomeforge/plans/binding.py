"""How queries are registered and bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name, with the SQL that DuckDB answers with the same rows."""

        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.oracles[query.__name__] = sql
            return query

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stat rows made from customers and suppliers by integer arithmetic, in Spark SQL and DuckDB alike.
STAT_ROWS = """
SELECT c_custkey AS row_id, c_name AS nome, 'stats' AS table_type,
  CAST(c_custkey % 23 AS INT) AS forca, CAST(c_custkey % 17 AS INT) AS habilidade, CAST(c_custkey % 13 AS INT) AS resistencia,
  CAST(c_custkey % 7 AS INT) AS armadura, CAST(c_custkey % 211 AS INT) AS pv, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 41 AS INT) END AS pm
FROM customer
"""
#: Equipment rows made from parts.
EQUIPMENT_ROWS = """
SELECT p_partkey AS row_id, p_name AS nome, 'equipamentos' AS table_type, 'item' AS tipo, p_type AS descricao, p_brand AS marca,
  CAST(p_size AS INT) AS pe, p_retailprice AS preco,
  CASE WHEN p_partkey % 3 = 0 THEN concat(CAST(1 + p_partkey % 4 AS STRING), 'd', CAST(4 + 2 * (p_partkey % 4) AS STRING), '+', CAST(p_partkey % 5 AS STRING)) END AS dano,
  CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey % 9 AS INT) END AS defesa
FROM part
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Rows of a SQL text over the given tables, under names of this call alone."""
    for name in names:
        sql = sql.replace(f"FROM {name}\n", f"FROM parquet.`{sf_dir}/{name}.parquet`\n")
    return spark.sql(sql)


def stat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, STAT_ROWS, "customer")


def equipment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, EQUIPMENT_ROWS, "part")


def duck(sql: str) -> str:
    """The same rows for DuckDB, as a CTE body."""
    return sql.replace("STRING", "VARCHAR")
