"""Guarded back-fills: a table is worked through in windows of its key, each published only after its checks.

A window is one job: its rows are judged, what is new is written to a folder of its own, and the counts that the checks need
are observed in the same pass. A ledger has a row for each window that was tried. Readers follow the ledger, so a window that
fails its checks, or a job that dies half way, leaves nothing to be seen; the next run goes on after the last window applied.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LEDGER = "run string, start_key long, end_key long, metrics map<string,long>, status string, reason string, folder string, step long"


@dataclass(frozen=True)
class Guard:
    """A check on a window's counts: ``broken`` tells whether they stop the run."""

    reason: str
    broken: Callable[[dict[str, int]], bool]


def share_over(name: str, limit: float) -> Guard:
    """More than a share of the rows read."""
    return Guard(f"{name}_over_{limit}", lambda m: m[name] > limit * max(m["read"], 1))


def count_over(name: str, limit: int = 0) -> Guard:
    return Guard(f"{name}_over_{limit}", lambda m: m[name] > limit)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A row for each window tried, in order of ``step``."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(_LEDGER).parquet(f"{path}/ledger")
    return spark.createDataFrame([], _LEDGER)


def published(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all windows applied."""
    folders = [r["folder"] for r in ledger(spark, path).where("status = 'applied'").select("folder").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


@contextmanager
def _whole_plans(spark: SparkSession) -> Iterator[None]:
    """Meanwhile stages that turn out empty stay in their plans: what they observed would go with them."""
    name = "spark.sql.adaptive.optimizer.excludedRules"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ",".join(filter(None, [before, "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"])))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_windows(
    rows: DataFrame,
    key: str,
    path: str,
    width: int,
    verdict: Column,
    relations: Callable[[DataFrame], DataFrame],
    unique: list[str],
    guards: list[Guard],
    verdicts: list[str],
    windows: int = 1_000_000,
    apply: bool = True,
) -> DataFrame:
    """Works on from the last window applied, for a number of windows, up to the first that breaks a guard; returns the ledger.

    ``verdict`` says of each row whether it is accepted; ``relations`` makes the target's rows of the accepted ones, of which
    those are new whose ``unique`` columns the target lacks. A window's counts are ``read``, one for each of ``verdicts``,
    and ``new``. Without ``apply`` each window is judged and nothing is kept; dry runs start where the ledger stands.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex[:8]
    schema = relations(rows).schema
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    done = ledger(spark, path).agg(F.max(F.when(F.col("status") == "applied", F.col("end_key"))).alias("end"), F.max("step").alias("step")).first()
    cursor, step = (ends["low"] - 1 if ends["low"] is not None else 0) if done["end"] is None else done["end"], done["step"] or 0
    for _ in range(windows):
        if ends["high"] is None or cursor >= ends["high"]:
            break
        end, folder, judged, added = cursor + width, f"{path}/windows/{uuid.uuid4().hex}", Observation(), Observation()
        marked = rows.where(F.col(key).between(cursor + 1, end)).withColumn("_verdict", verdict)
        marked = marked.observe(judged, F.count("*").alias("read"), *[F.count_if(F.col("_verdict") == v).alias(v) for v in verdicts])
        made = relations(marked.where("_verdict = 'accepted'").drop("_verdict")).dropDuplicates(unique)
        new = made.join(published(spark, path, schema).select(*unique), unique, "left_anti").select(schema.names).observe(added, F.count("*").alias("new"))
        with _whole_plans(spark):
            if apply:
                new.write.parquet(folder)
            else:
                new.write.format("noop").mode("overwrite").save()
            metrics = judged.get | added.get
        broken = next((g.reason for g in guards if g.broken(metrics)), None)
        status, step = "blocked" if broken else "applied" if apply else "dry_run", step + 1
        spark.createDataFrame([(run, cursor + 1, end, metrics, status, broken, folder, step)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
        if broken:
            break
        cursor = end
    return ledger(spark, path)
