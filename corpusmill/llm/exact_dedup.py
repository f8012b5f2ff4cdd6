"""Exact dedup against a persistent digest index, with DataFrame functions only.

The index is a Parquet table of digests and the ids that stay, bucketed and sorted by digest. A batch of new rows is brought
to one row a digest, meets the index in a sort-merge anti-join in which only the batch moves, and what is new is appended.
The table's folder is all of its state: a later session declares its buckets again and goes on where the last one stopped.
A batch that is run again after a failure finds its own entries and gives the same result.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import shared_dir, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of more than one in so many rows are broadcast, so there are never more of them than this number.
HOT_PART = 2048


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    # a text of ASCII alone takes the fast way
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))


def digest(text: Column) -> Column:
    """The 32 bytes of SHA-256 over the text in lower case (A-Z only)."""
    return F.unhex(F.sha2(lower_ascii(text), 256))


class DigestIndex:
    """The digests seen so far, in ``path``: one entry for each, with the id of the row that stays.

    ``buckets`` counts when the index is made (default: the session's number of shuffle partitions) and is read from the
    folder afterwards. Append from one job at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.buckets = spark.read.schema("buckets int").parquet(f"{self.path}/made").first()[0]
        except AnalysisException:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(f"{self.path}/made")
        self.name = "digests_" + hashlib.md5(self.path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'"
        )

    def entries(self) -> DataFrame:
        """``digest`` and ``keep_id``; joins on ``digest`` don't move them."""
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Appends the digests of ``rows`` (``_id``, ``_digest``) that the index lacks; of equal ones in ``rows`` the largest id stays."""
        groups = rows.groupBy(F.col("_digest").alias("digest")).agg(F.max("_id").alias("keep_id"))
        groups.join(self.entries().hint("merge"), "digest", "left_anti").write.insertInto(self.name)

    def copied_to(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The same entries as a new index with one file a bucket: for one of many small appends, or for more buckets."""
        new = DigestIndex(self.spark, path, buckets or self.buckets)
        self.entries().repartition(new.buckets, "digest").write.insertInto(new.name)
        return new


def by_falling_id(rows: DataFrame, batches: int) -> list[DataFrame]:
    """``rows`` in batches of about equal size from the largest ids down; rows without id come last."""
    cuts = rows.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else None
    edges = [None, *sorted(set(cuts or []), reverse=True), None]
    out = []
    for above, below in zip(edges, edges[1:]):
        part = rows if above is None else rows.where((F.col("_id") <= above) | F.col("_id").isNull()) if below is None else rows.where(F.col("_id") <= above)
        out.append(part if below is None else part.where(F.col("_id") > below))
    return out


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row of ``docs``.

    Texts are equal when they are after lower-casing A-Z; null counts as empty, and long texts are hashed whole. An id that
    the index held before stays; among the rows of ``docs`` the largest id does, since they come in batches of falling ids.
    ``group_size`` counts rows of ``docs``. Rows that repeat an id and text all have the same result; rows without id stay
    only where no row of their text has one. An empty table gives an empty result. Other columns, whatever their names,
    play no part. Without ``index``, a new one in the shared folder serves.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}")
    rows = written(docs.select(F.col(id_col).cast("long").alias("_id"), digest(F.col(text_col)).alias("_digest")), "rows")
    for batch in by_falling_id(rows, batches):
        index.add(batch)
    sizes = rows.groupBy(F.col("_digest").alias("digest")).agg(F.count("*").alias("group_size"))
    groups = written(sizes.join(index.entries().hint("merge"), "digest"), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    # at most HOT_PART groups have more than that share of all rows; their rows need not move
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_PART > total).withColumnRenamed("digest", "_digest"))
    others = groups.where(F.col("group_size") * HOT_PART <= total).withColumnRenamed("digest", "_digest")
    found = rows.join(hot, "_digest").unionByName(rows.join(hot.select("_digest"), "_digest", "left_anti").join(others, "_digest"))
    return found.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))
