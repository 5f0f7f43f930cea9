"""Stack sums that grow with arriving frames: each micro-batch adds its partial sums of cells to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.stats import clean


def partial_sums(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, m2, low, high) of known values; cells without one give no row."""
    v = clean(value)
    sums = samples.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("_v"), F.min(v).alias("low"), F.max(v).alias("high"))
    return sums.select(*keys, "n", "mean", (F.col("n") * F.col("_v")).alias("m2"), "low", "high")


def accumulate(stream: DataFrame, keys: list[str], value: str, path: str) -> DataStreamWriter:
    """A stream that writes every micro-batch's partial sums below a shared path, in a folder named by its id.

    A batch that runs again after a failure overwrites its own folder, so nothing counts twice.  Late frames need no care: sums
    don't depend on the order.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        partial_sums(batch, keys, value).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each)


def accumulated(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, n, mean, variance, low, high) over all batches so far; variances merge about the common mean, in one shuffle."""
    parts = spark.read.parquet(path)
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    rows = parts.withColumn("_mean", mean).withColumn("_m2", F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"), (F.sum("_m2") / F.sum("n")).alias("variance"), F.min("low").alias("low"), F.max("high").alias("high"))
