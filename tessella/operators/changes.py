"""Keyed tables that take batches of changes: only the buckets that a batch touches are written again.

A table is a folder of Parquet files, partitioned by a hash of the key. Each row keeps the batch that last changed it, and
deleted rows stay as marks, so that a batch which comes again, or late, changes nothing that a later one has written. Spark
writes the touched partitions aside and moves them in at the end (dynamic partition overwrite); where a job fails before that is over, the batch
is applied again. The changes themselves are kept beside the table, by batch.

One writer at a time; batches are numbered by the caller, as a stream numbers its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import storage

#: Columns of a stored table besides its own.
BATCH, GONE = "_batch", "_deleted"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _replace(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def log_of(path: str) -> str:
    """Where the changes of the table at ``path`` are kept."""
    return f"{path.rstrip('/')}_changes"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, with marks of deleted ones, their batches and buckets."""
    return spark.read.parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows with the columns that were put."""
    rows = stored(spark, path)
    return rows.where(~F.col(GONE)).select(*(c for c in rows.columns if c not in (BATCH, GONE) and not c.startswith("_bucket_of_")))


def apply(path: str, changes: DataFrame, keys: list[str], batch: int, buckets: int = 256, op: str = "op", whole: bool = False) -> None:
    """Puts a batch of changes into the table at ``path``, which it makes where there is none.

    changes: the keys, other columns, and ``op``, 'put' or 'delete' (null: put). A put adds a row or replaces those of its values that
    aren't null, as :func:`graph.upsert` does, or with ``whole`` all values that the changes have a column for; after a delete it starts anew. Of several changes of one key in a batch a put wins, and of
    puts the greatest. Rows with a null in a key are left out, as they name nothing; an empty batch touches nothing.
    Columns new to the table are added to it: they are null in buckets not yet touched. Names that start with an underscore are kept for the table.
    """
    spark, bucket = changes.sparkSession, f"_bucket_of_{buckets}"
    values = [c for c in changes.columns if c not in (*keys, op)]
    named = changes.dropna(subset=keys).withColumn(op, F.coalesce(op, F.lit("put")))
    one = named.groupBy(*keys).agg(F.max(F.struct(op, *values)).alias("_new"))
    new = storage.cut(one.select(*keys, "_new", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(bucket)))
    touched = [r[bucket] for r in new.select(bucket).distinct().collect()]  # at most as many as there are buckets
    if not touched:
        return
    _replace(new.select(*keys, "_new.*", F.lit(batch).cast("long").alias(BATCH)), log_of(path), BATCH)
    is_put = F.col(f"_new.{op}") == "put"
    if not _exists(spark, path):
        out = new.select(*keys, *(F.when(is_put, F.col(f"_new.{c}")).alias(c) for c in values), F.lit(batch).cast("long").alias(BATCH), (~is_put).alias(GONE), bucket)
        return _replace(out.repartition(bucket), path, bucket)
    old = spark.read.option("mergeSchema", True).parquet(path)
    if bucket not in old.columns:
        raise ValueError(f"the table at {path} has another number of buckets")
    was = [c for c in old.columns if c not in (*keys, BATCH, GONE, bucket)]
    old = old.where(F.col(bucket).isin(touched)).select(*keys, bucket, F.struct(*was, BATCH, GONE).alias("_old"))
    both = old.join(new, [*keys, bucket], "full")
    wins = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col(f"_old.{BATCH}") <= batch))
    fresh = F.col("_old").isNull() | F.col(f"_old.{GONE}")

    def value(name: str):
        before = F.col(f"_old.{name}") if name in was else F.lit(None)
        after = F.col(f"_new.{name}") if name in values else F.lit(None)
        return F.when(wins & is_put, after if whole and name in values else F.coalesce(after, F.when(~fresh, before))).when(~wins, before).alias(name)

    every = [*was, *(c for c in values if c not in was)]
    out = both.select(*keys, *(value(c) for c in every), F.when(wins, F.lit(batch).cast("long")).otherwise(F.col(f"_old.{BATCH}")).alias(BATCH), F.when(wins, ~is_put).otherwise(F.col(f"_old.{GONE}")).alias(GONE), bucket)
    _replace(storage.cut(out.repartition(bucket)), path, bucket)


def delete_where(spark: SparkSession, path: str, condition: str, keys: list[str], batch: int, buckets: int = 256) -> None:
    """Deletes the rows that the condition holds for, such as one run's edges; buckets without any stay as they are."""
    apply(path, current(spark, path).where(condition).select(*keys, F.lit("delete").alias("op")), keys, batch, buckets)


def replay(spark: SparkSession, path: str, batch: int, keys: list[str], buckets: int = 256, whole: bool = False) -> None:
    """Applies a batch again from the kept changes, after a failure."""
    apply(path, spark.read.parquet(log_of(path)).where(F.col(BATCH) == batch).drop(BATCH), keys, batch, buckets, whole=whole)
