"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import saved

#: Rows of a side that a join may broadcast; a larger side is shuffled.
BROADCAST_ROWS = 100_000
#: While a table is written: bytes of the batches that a task hands to Python, and rows that it reads of
#: a file at once. A batch of whole texts by the default numbers takes some hundred megabytes of a task.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def stored(df: DataFrame) -> DataFrame:
    """Write a table that is read several times, compressed, and read it back: what reads it does
    not depend on the executors that made it. Texts are read and go to Python in small batches."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        conf.set(k, v)
    try:
        return saved(df)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v else conf.unset(k)


def matching(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of a large table whose key is among stored `keys` (or, with `inner`, joined to them).
    Few keys are broadcast after they are counted; others are joined by shuffle."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, key, how)
