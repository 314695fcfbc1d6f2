"""Session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job relies on. Timestamps are instants in UTC.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None,
          **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in RUNTIME.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        b = b.config(k, v)
    return b.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: `spark.checkpoint.dir`, or where that is unset a folder
    beside the tables of the warehouse. Never a machine's own temporary folder."""
    sc = spark.sparkContext
    found = (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
             or sc.getConf().get("spark.checkpoint.dir"))
    if found:
        return found
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Store a reduced intermediate in the checkpoint folder, so that plans reading it several
    times neither recompute it nor depend on the executors that made it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """Write a table of many rows that is read several times, compressed, to the shared folder and
    read it back; only the columns that a reader needs are read."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
