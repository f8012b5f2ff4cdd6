"""Readers and writers: folders of tables, JSON feeds, checkpoints, snapshots by date, tables replaced in one step."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_dir(spark: SparkSession) -> str:
    """This application's folder for written tables, in the one that spark.checkpoint.dir names; where that is unset, a temporary folder serves if all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a table in this application's folder; lineage is cut."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in ``parts`` partitions, where the session has fewer: parts that grow with the input keep each task's share as it is."""
    fewer = parts is None or parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if fewer else df.repartition(parts, *keys)


def drop_written(spark: SparkSession) -> None:
    """Deletes what this application wrote on the way; call it once results that read from it are written themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unwrapped(json: Column, wrappers: tuple[str, ...] = ("_source", "source", "raw_data")) -> Column:
    """The document inside a JSON text: under the first wrapper that it has, else itself."""
    return F.coalesce(*[F.get_json_object(json, f"$.{w}") for w in wrappers], json)


def with_fallback(df: DataFrame, store: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """``df`` with a stored value under its key, or else under the key with a prefix."""
    a = store.select(F.col("key").alias("_k1"), F.col(value).alias("_v1"))
    b = store.select(F.col("key").alias("_k2"), F.col(value).alias("_v2"))
    return df.join(a, F.col(key) == F.col("_k1"), "left").join(b, F.concat(F.lit(prefix), F.col(key)) == F.col("_k2"), "left").withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def in_range(df: DataFrame, ts: str, start: str | None, end: str | None, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Rows between two times, or of the last days before one; what isn't given doesn't filter."""
    if days is not None and as_of is not None:
        end, begin = as_of, F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    else:
        begin = F.lit(start).cast("timestamp") if start else None
    df = df.where(F.col(ts) >= begin) if begin is not None else df
    return df.where(F.col(ts) < F.lit(end).cast("timestamp")) if end else df


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes a table by partitions; only partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_table(df: DataFrame, path: str) -> str:
    """Writes a new version of a table beside the old ones and returns its folder; once it is whole, it is listed in ``current``."""
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/current")
    return f"{path.rstrip('/')}/{version}"


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that was written to its end."""
    last = spark.read.schema("version string").parquet(f"{path.rstrip('/')}/current").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path.rstrip('/')}/{last}")
