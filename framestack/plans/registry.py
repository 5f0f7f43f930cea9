"""Registration of the queries: a name, a function of (spark, sf_dir), and SQL with the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task gets from dealt(), on average.
TASK_ROWS = 1 << 19


def tasks(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to tasks of about TASK_ROWS of its `rows` rows: what a task sorts or groups does not grow with the table."""
    return df.repartition(tasks(df.sparkSession, rows), *keys)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded; a tie of the true value falls the same way in any order of addition."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)
