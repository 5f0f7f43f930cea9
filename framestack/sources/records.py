"""Tabular sources and sinks: measurement tables, decisions, catalogues, canonical receipts, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DECISION = "struct<sourceSha256:string,decision:string,defaultDecision:string,flags:array<string>,note:string>"


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decisions of selection files; rows of an unknown decision or without a digest have `error` set."""
    raw = spark.read.option("multiLine", True).schema(f"schemaVersion int, kind string, undecided string, decisions array<{DECISION}>").json(path)
    rows = raw.select("undecided", F.explode("decisions").alias("d")).select("undecided", "d.*")
    error = F.when(F.col("sourceSha256").isNull(), "no digest").when(~F.coalesce(F.col("decision").isin("KEEP", "DROP"), F.lit(False)), "unknown decision")
    return rows.withColumn("error", error)


def decided(assets: DataFrame, chosen: DataFrame, digest: str = "sha256", undecided: str = "ERROR") -> DataFrame:
    """Assets with their decision; those without one get the files' own `undecided`, else the argument; conflicting ones are CONFLICT."""
    said = chosen.where("error is null").groupBy(F.col("sourceSha256").alias(digest))
    one = said.agg(F.when(F.count_distinct("decision") > 1, "CONFLICT").otherwise(F.max("decision")).alias("decision"))
    rest = chosen.agg(F.max("undecided").alias("_rest")) if "undecided" in chosen.columns else chosen.agg(F.lit(None).cast("string").alias("_rest"))  # one row
    return assets.join(one, digest, "left").crossJoin(F.broadcast(rest)).withColumn("decision", F.coalesce("decision", "_rest", F.lit(undecided))).drop("_rest")


def measurement_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Row-wise tables in JSON, {"columns": [...], "rows": [[...], ...]}, as typed columns; values that don't fit are null and counted in `bad`."""
    raw = spark.read.option("multiLine", True).schema("columns array<string>, rows array<array<string>>").json(path)
    rows = raw.select("columns", F.posexplode("rows").alias("row", "values")).withColumn("m", F.map_from_arrays("columns", "values"))
    out = rows.select("row", "m", *[F.element_at("m", name).try_cast(kind).alias(name) for name, kind in columns.items()])
    bad = sum((F.when(F.element_at("m", n).isNotNull() & F.col(n).isNull(), 1).otherwise(0) for n in columns), F.lit(0))
    return out.withColumn("bad", bad).drop("m")


def cone(stars: DataFrame, ra: float, dec: float, radius: float, flux: str, most: int, ra_col: str = "ra", dec_col: str = "dec") -> DataFrame:
    """The brightest stars within a cone (degrees): a declination band prunes files before the exact test."""
    from ..functions.sky import separation

    band = stars.where((F.col(dec_col) >= dec - radius) & (F.col(dec_col) <= dec + radius))
    d = separation(F.col(ra_col), F.col(dec_col), F.lit(ra), F.lit(dec))
    return band.withColumn("separation", d).where(F.col("separation") <= radius).orderBy(F.col(flux).desc(), ra_col, dec_col).limit(most)


def by_sky_cell(stars: DataFrame, path: str, degrees: float = 5.0, dec_col: str = "dec") -> None:
    """Write a star table for cone(): partitioned by declination zone, sorted by declination within files."""
    zone = F.floor((F.col(dec_col) + 90) / degrees).cast("int")
    stars.withColumn("zone", zone).repartition("zone").sortWithinPartitions("zone", dec_col).write.partitionBy("zone").parquet(path)


def canonical(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Compact JSON of the columns in name order, nulls written out."""
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def with_receipt(df: DataFrame, out: str = "receipt") -> DataFrame:
    """df with `sha256:` and the digest of its canonical row."""
    return df.withColumn(out, F.concat(F.lit("sha256:"), F.sha2(canonical(df), 256)))


def write_new(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write to a place that must not exist; Spark's commit makes it appear whole."""
    df.write.mode("errorifexists").options(**options).format(fmt).save(path)


def missing_from_cache(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What is not measured yet, by content and configuration digests."""
    return wanted.join(cached.select(*keys).distinct(), keys, "left_anti")


def pruned_cache(cached: DataFrame, stale_before: Column | str, stamp: str = "measured_at") -> DataFrame:
    return cached.where(F.col(stamp) >= stale_before)
