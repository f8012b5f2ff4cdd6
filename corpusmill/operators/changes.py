"""Tables that change: upserts, patches, snapshots, dimensions, change logs, and moves between states.

Each operator gives the new state of a table from its old state and a batch of rows; writing it is the caller's choice
(``sources.tables`` has atomic and partitioned writers).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.joins import numbered


def upsert(old: DataFrame, new: DataFrame, key: str, skip: Column | None = None) -> DataFrame:
    """Old rows with the batch merged in: nulls of the batch keep old values, new keys are added.

    ``skip`` is a condition on the old row (columns as in the table); where it holds the old row stays as it is.
    """
    o = old.select(F.col(key), *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key], F.lit(True).alias("_old"), *([skip.alias("_skip")] if skip is not None else [F.lit(False).alias("_skip")]))
    n = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    both = o.join(n, key, "full_outer")
    keep = F.col("_old") & F.col("_skip")
    pick = lambda c: F.when(keep, F.col(f"_o_{c}")).otherwise(F.coalesce(f"_n_{c}", f"_o_{c}")) if c in new.columns else F.col(f"_o_{c}")
    return both.select(*[F.col(c) if c == key else pick(c).alias(c) for c in old.columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows and, of the batch, the first row of each key that the table lacks."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch's last row of each key in place of the old one; columns that the batch lacks are null in it."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Old and new rows of a key by a rule for each column: overwrite, coalesce, keep, add, greatest or least."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in rules], F.lit(True).alias("_old"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in rules], F.lit(True).alias("_new"))

    def pick(c: str) -> Column:
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        both = {
            "overwrite": b, "coalesce": F.coalesce(b, a), "keep": F.coalesce(a, b), "add": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "greatest": F.greatest(a, b), "least": F.least(a, b),
        }[rules[c]]
        return F.when(F.col("_old").isNull(), b).when(F.col("_new").isNull(), a).otherwise(both).alias(c)

    return o.join(n, key, "full_outer").select(key, *[pick(c) for c in rules])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The batch's rows in place of all old rows of the parents that it names."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def dimension_ids(dimension: DataFrame, codes: DataFrame, code: str, key: str) -> DataFrame:
    """The dimension with ids for new codes: after the greatest id, in the order of codes.

    Places come from a range sort, so no task numbers all of them.
    """
    fresh = codes.select(code).where(F.col(code).isNotNull()).distinct().join(dimension.select(code), code, "left_anti")
    top = dimension.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    new = numbered(fresh, [F.col(code)], "_r").crossJoin(F.broadcast(top)).select(code, (F.col("_top") + F.col("_r")).cast("long").alias(key))
    return dimension.select(code, key).unionByName(new)


def change_log(old: DataFrame, new: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """One row for each tracked column that differs between the states of a key (null counts as a value)."""
    o = old.select(key, *[F.col(c).cast("string").alias(f"_o_{c}") for c in tracked])
    n = new.select(key, *[F.col(c).cast("string").alias(f"_n_{c}") for c in tracked])
    changes = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_o_{c}").alias("before"), F.col(f"_n_{c}").alias("after")) for c in tracked])
    return o.join(n, key).select(key, F.explode(F.filter(changes, lambda x: ~x["before"].eqNullSafe(x["after"]))).alias("_c")).select(key, "_c.*")


def snapshot(df: DataFrame, date: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of an aggregate, marked with a snapshot's date."""
    return df.orderBy(*order).limit(limit).withColumn("snapshot_date", F.lit(date))


def latest_snapshot(snapshots: DataFrame, date: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot."""
    newest = snapshots.agg(F.max(date).alias("_d"))
    return snapshots.join(F.broadcast(newest), F.col(date) == F.col("_d")).drop("_d")


def check_out(df: DataFrame, eligible: Column, order: list[Column], n: int, state: str, to: str, key: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(table, events): the first ``n`` eligible rows move to a state, and an event says so for each."""
    chosen = df.where(eligible).orderBy(*order).limit(n).select(key, F.col(state).alias("_from"))
    table = df.join(chosen.select(key, F.lit(True).alias("_chosen")), key, "left").withColumn(state, F.when(F.col("_chosen"), F.lit(to)).otherwise(F.col(state))).drop("_chosen")
    events = chosen.select(key, F.lit("checked_out").alias("event_type"), F.col("_from").alias("status_from"), F.lit(to).alias("status_to"), as_of.alias("created_at"))
    return table, events


def reclassify(df: DataFrame, state: str, key: str, rules: list[tuple[str, Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(table, history): each row takes the state of the first rule (name, condition, state) that holds; changes are listed."""
    target = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(to).alias("to"))) for name, c, to in rules])
    marked = df.withColumn("_t", target)
    history = marked.where(F.col("_t").isNotNull() & ~F.col(state).eqNullSafe(F.col("_t.to"))).select(key, F.col("_t.rule").alias("rule"), F.col(state).alias("status_from"), F.col("_t.to").alias("status_to"))
    return marked.withColumn(state, F.coalesce(F.col("_t.to"), F.col(state))).drop("_t"), history


def stuck(df: DataFrame, ts: str, as_of: Column, hours: int, states: Column) -> DataFrame:
    """Rows in certain states that haven't moved for some hours."""
    return df.where(states & (F.col(ts) < as_of - F.make_dt_interval(F.lit(0), F.lit(hours))))


def events_of(df: DataFrame, key: str, event_type: str, fields: list[str], as_of: Column) -> DataFrame:
    """Log rows with some fields as JSON."""
    return df.select(key, F.lit(event_type).alias("event_type"), F.to_json(F.struct(*fields)).alias("metadata"), as_of.alias("created_at"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
