"""What is known about rows of a scan, stored by scan partition.

monotonically_increasing_id names a row by its scan partition and place, alike in each scan of a table or
checkpoint. Rows about rows are stored by that partition, and the task that scans it reads its
own: a join without moving the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = 33  # the partition is above these bits


def numbered(docs: DataFrame, name: str = "r") -> DataFrame:
    return docs.withColumn(name, F.monotonically_increasing_id())


def store(rows: DataFrame, at: str) -> None:
    """Stores rows about scanned rows r."""
    rows.withColumn("part", F.shiftright("r", _PART)).repartition("part").sortWithinPartitions("part", "r").write.partitionBy("part").parquet(at)


def stored(at: str, r: int) -> dict[str, np.ndarray]:
    """What is stored for the scan partition of row r."""
    fs, base = pafs.FileSystem.from_uri(at)
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{base}/part={r >> _PART}", allow_not_found=True)) if x.path.endswith(".parquet")]
    if not files:
        return {}
    table = pa.concat_tables(pq.ParquetFile(fs.open_input_file(x)).read() for x in sorted(files))
    return {k: table.column(k).to_numpy() for k in table.column_names}


def rows_of(side: dict[str, np.ndarray], r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the stored rows of a batch, and the place of each one's text in the batch."""
    if not side or not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((side["r"] >= r[0]) & (side["r"] <= r[-1]))
    return at, np.searchsorted(r, side["r"][at])
