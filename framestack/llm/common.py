"""Helpers shared by the corpus operators: table access, bounded Arrow batches, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 8) -> None:
    """Bound what one Arrow batch to Python holds, by rows and by bytes, so long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local temporary one only where none is configured (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.conf.get("framestack.scratch", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("framestack.scratch", conf)
    return conf


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framestack-{uuid.uuid4().hex[:12]}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path.getParent())
    return spark.read.schema(df.schema).parquet(path)


def key_crc(key: str = "doc_id") -> Column:
    """crc32 of the key's decimal text; decides folds."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def free_name(names: list[str], base: str) -> str:
    """base, with as many underscores behind it as make it none of the names (case aside)."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled_ids(ids: DataFrame, key: str, total: int, wanted: int) -> DataFrame:
    """Rows of ids whose key hashes below wanted/total: a repeatable sample of about `wanted` rows."""
    if total <= wanted:
        return ids
    cut = int(wanted / total * (1 << 30))
    return ids.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < cut)


def with_totals(df: DataFrame, keys: list[str], deal: Column, totals: dict[str, str], how=F.try_sum, salts: int = 64) -> DataFrame:
    """df with totals over all rows of equal keys (nulls are equal), as new columns {name: column}; `how` must add up from parts.

    Rows are dealt by key and a salt from `deal`, so the rows of a hot key spread over `salts` groups: sums are made by
    (key, salt), then by key, and go back by (key, salt).  Both sides of the join grow with the groups that exist, and
    no group is larger than a salt's share of a key.
    """
    salt = free_name(df.columns, "salt")
    rows = df.withColumn(salt, F.pmod(deal, F.lit(salts)).cast("int"))
    parts = rows.groupBy(*keys, salt).agg(*[how(c).alias(n) for n, c in totals.items()])
    whole = parts.groupBy(*keys).agg(*[how(n).alias(n) for n in totals], F.collect_set(salt).alias(salt))
    back = whole.select(*keys, *totals, F.explode(salt).alias(salt))
    left, right = rows.alias("l"), back.alias("r")
    same = F.lit(True)
    for k in [*keys, salt]:
        same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    return left.join(right, same).select("l.*", *[F.col(f"r.`{n}`") for n in totals]).drop(salt)
