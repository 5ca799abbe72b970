"""Where queries register: a function of (tables), its name, and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plexar.session import ship


class Tables:
    """t("orders") reads a table; t.spark and t.dir are at hand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.dir = spark, folder
        ship(spark)

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def views(self, *names: str) -> None:
        for n in names:
            self(n).createOrReplaceTempView(n)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables under its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"query exists: {f.__name__}")
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def sql_query(name: str, *tables: str, spark: str, duck: str | None = None) -> None:
    """Registers SQL text over tables; the same text is the oracle where duck is not given."""

    def run(session: SparkSession, folder: str) -> DataFrame:
        Tables(session, folder).views(*tables)
        return session.sql(spark)

    QUERIES[name] = run
    ORACLE_SQL[name] = duck or spark
