"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def bounded_sample(rows: DataFrame, key: str, stratum: str, most: int, in_all: int = 1 << 40) -> DataFrame:
    """``most`` rows of each stratum at most, and ``in_all`` shared out evenly, those of the smallest hash of the key.

    The strata are label values, of which a table has few. One narrow pass counts them; a share by hash with
    a margin is then a filter, and only what passes it is ranked.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}
    most = max(1, min(most, in_all // max(1, len(counts))))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(stratum).eqNullSafe(F.lit(value)), F.lit(min(1.0, (most + 6 * most**0.5) / max(n, 1)))).otherwise(share)
    by = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(by, key, F.xxhash64(*rows.columns)))
    return rows.where(by < share * (1 << 20)).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
