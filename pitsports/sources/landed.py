"""Sources: typed reads of landed CSV, JSON and Parquet, with missing columns as typed nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsports.operators.tables import conform


def scan_seasons(spark: SparkSession, path: str, schema: T.StructType, seasons: Sequence[int] | None = None) -> DataFrame:
    """Season-partitioned Parquet (``season=<year>``), read by name with a fixed schema; seasons prune partitions."""
    df = conform(spark.read.option("mergeSchema", "true").parquet(path), schema)
    return df.where(F.col("season").isin(*seasons)) if seasons else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, optional: bool = False) -> DataFrame:
    """CSV with a header; a missing optional input gives an empty typed frame. Empty fields become null."""
    if optional:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def split_by(df: DataFrame, discriminator: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """One typed frame for each value of a discriminator column."""
    return {name: conform(df.where(F.col(discriminator) == name), schema) for name, schema in schemas.items()}


def exploded_json(df: DataFrame, column: str, schema: str, path: str) -> DataFrame:
    """Parse a JSON column and explode the array or map at ``path`` of it; other columns stay."""
    parsed = df.withColumn("_json", F.from_json(column, schema))
    return parsed.select(*[c for c in df.columns if c != column], F.explode(f"_json.{path}"))


def natural_rows(df: DataFrame, renames: dict[str, str], key: Sequence[str], drop: Column) -> DataFrame:
    """Raw export to canonical rows: rename, drop unwanted rows and rows without a full key, NaN to null."""
    kinds = dict(df.dtypes)
    out = df.where(~F.coalesce(drop, F.lit(False))).select(
        *[(F.when(~F.isnan(old), F.col(old)) if kinds[old] in ("double", "float") else F.col(old)).alias(new) for old, new in renames.items()]
    )
    return out.dropna(subset=list(key))


def weeks(start: str, end: str, spark: SparkSession, days: int = 7) -> DataFrame:
    """Chunks (lo, hi) of a date range, ``hi`` inclusive."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {days} days"))).alias("lo"))
    return one.select("lo", F.least(F.date_add("lo", days - 1), F.lit(end).cast("date")).alias("hi"))


def season_frame(facts: DataFrame, season: int, keys: Sequence[str]) -> DataFrame:
    """The facts of one season; fails if there are none or if a key is null in all of them."""
    rows = facts.where(F.col("season") == season)
    seen = rows.agg(F.count("*").alias("n"), *[F.count(k).alias(k) for k in keys]).first()
    if not seen["n"]:
        raise FileNotFoundError(f"no facts of season {season}")
    empty = [k for k in keys if not seen[k]]
    if empty:
        raise ValueError(f"season {season}: {', '.join(empty)} has no value")
    return rows
