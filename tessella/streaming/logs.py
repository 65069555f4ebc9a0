"""Append-only logs as streams: latest row per key, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessella.operators import changes


def read_log(spark: SparkSession, path: str, schema: str, per_batch: int = 500) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def latest(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key; the same on a table and, in update mode, on a stream."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("row")).select(key, *(F.col(f"row.{v}").alias(v) for v in values))


def first_and_latest(rows: DataFrame, key: str, time: str, values: list[str], late: str = "1 hour", expire: str = "7 days") -> DataFrame:
    """key, first_seen, last_seen and the values of the key's last row; of rows at one time the greatest by its values as JSON.

    On a table this is one aggregation. On a stream each key's state is one row, given out anew when rows of the key come (update mode), and
    dropped when the watermark passes its last row by ``expire``, so that state grows with the keys of that time and not for ever; a key that returns
    after that is first seen anew. Rows later than the watermark are left out on a stream, and those with a null key or time on both.
    """
    own = rows.schema[key].dataType.simpleString()
    kinds = ", ".join(f"`{v}` {rows.schema[v].dataType.simpleString()}" for v in values)
    rows = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    packed = F.to_json(F.struct(*values)).alias("_row")
    if rows.isStreaming:
        kept = int(pd.Timedelta(expire).total_seconds() * 1000)
        moment = F.unix_micros(F.col(time).cast("timestamp")).alias("_at")

        def step(named: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            first, last, row = state.get if state.exists else (None, None, None)
            for part in parts:
                top = part.loc[part["_at"] == part["_at"].max(), ["_at", "_row"]].max()
                low = int(part["_at"].min())
                first = low if first is None else min(first, low)
                if last is None or (int(top["_at"]), top["_row"]) > (last, row):
                    last, row = int(top["_at"]), top["_row"]
            state.update((first, last, row))
            state.setTimeoutTimestamp(last // 1000 + kept)
            yield pd.DataFrame({key: [named[0]], "_first": [first], "_last": [last], "_row": [row]})

        marked = rows.withWatermark(time, late).select(key, time, moment, packed)
        out = marked.groupBy(key).applyInPandasWithState(step, f"`{key}` {own}, _first long, _last long, _row string", "first long, last long, row string", "update", GroupStateTimeout.EventTimeTimeout)
    else:
        moment = F.unix_micros(F.col(time).cast("timestamp"))
        top = rows.groupBy(key).agg(F.min(moment).alias("_first"), F.max(F.struct(moment.alias("at"), packed)).alias("top"))
        out = top.select(key, "_first", F.col("top.at").alias("_last"), F.col("top._row").alias("_row"))
    out = out.withColumn("_row", F.from_json("_row", kinds))
    return out.select(key, F.timestamp_micros("_first").alias("first_seen"), F.timestamp_micros("_last").alias("last_seen"), *(F.col(f"_row.`{v}`").alias(v) for v in values))


def into_table(stream: DataFrame, path: str, keys: list[str], at: str, buckets: int = 256, **trigger):
    """Keeps the table at ``path`` at the stream's latest rows by key; a batch that comes again after a restart from ``at`` changes nothing."""
    put = lambda rows, number: changes.apply(path, rows.withColumn("op", F.lit("put")), keys, number, buckets, whole=True)
    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", at).trigger(**(trigger or {"availableNow": True})).start()


def windowed(rows: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and key; rows later than the watermark are left out on a stream."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def in_batches(stream: DataFrame, work, at: str, seconds: int = 60):
    """Runs ``work(rows, number)`` on each micro-batch of a stream, one every so many seconds; a batch that failed is done again from the checkpoint ``at``."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", at).trigger(processingTime=f"{seconds} seconds").start()
