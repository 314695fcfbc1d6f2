"""Tables whose changes appear whole or not at all.

A table is a folder of writes (`write=<id>/<partitions>`) and of manifests (`_manifests/<version>.json`).
A manifest names, for every partition, the write that holds it. A change writes the partitions it
touches into a new write folder and then renames a manifest into place: until that moment readers see
the old table, afterwards the new one. A job that dies leaves a write that no manifest names; the old
files are not touched, and `vacuum` removes what no kept manifest names. One writer at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import DataError

WRITE, MANIFESTS = "write", "_manifests"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{path}/{MANIFESTS}") if n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """Partition folder (`a=1/b=2`) -> write, of a version (the newest by default); empty without one."""
    found = versions(spark, path)
    if not found:
        return {}
    if version is not None and version not in found:
        raise DataError(f"the table has no version {version}")
    fs, p = _files(spark, f"{path}/{MANIFESTS}/{found[-1] if version is None else version:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None, where=None) -> DataFrame:
    """The table at a version; `schema` includes the partition columns. `where` keeps partition folders
    by name, before any file is listed."""
    parts = {k: v for k, v in manifest(spark, path, version).items() if where is None or where(k)}
    if not parts:
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField(WRITE, T.StringType())])
    return spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/{WRITE}={w}/{k}" for k, w in sorted(parts.items())]).drop(WRITE)


def swap(spark: SparkSession, path: str, parts: dict[str, str], version: int) -> None:
    """Put a manifest in place, by renaming a finished file."""
    fs, folder = _files(spark, f"{path}/{MANIFESTS}")
    fs.mkdirs(folder)
    _, draft = _files(spark, f"{path}/{MANIFESTS}/.draft-{uuid.uuid4().hex}")
    _, final = _files(spark, f"{path}/{MANIFESTS}/{version:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise DataError(f"version {version} of the table was written by another job")


def replace(spark: SparkSession, path: str, rows: DataFrame, partitions: list[str], whole: bool = False) -> dict[str, str]:
    """Make `rows` the whole content of every partition that they hold rows of; others stay, or go
    where `rows` are the `whole` table. Returns the new manifest."""
    before = versions(spark, path)
    parts = {} if whole else manifest(spark, path)
    write = uuid.uuid4().hex
    rows.write.partitionBy(*partitions).parquet(f"{path}/{WRITE}={write}")
    parts |= dict.fromkeys(_leaves(spark, f"{path}/{WRITE}={write}", len(partitions)), write)
    swap(spark, path, parts, (before[-1] if before else 0) + 1)
    return parts


def _leaves(spark: SparkSession, path: str, depth: int) -> list[str]:
    level = [""]
    for _ in range(depth):
        level = [f"{k}/{n}".lstrip("/") for k in level for n in _names(spark, f"{path}/{k}".rstrip("/")) if "=" in n]
    return level


def keep_last(df: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """One row per key: that of the highest priority. Partially aggregated, so no key is sorted."""
    rest = [c for c in df.columns if c not in keys and c != priority]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(priority)).alias("_v"))
    return g.select(*keys, *[F.col("_v").getField(c).alias(c) for c in rest])


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; the incoming row wins on a conflict."""
    cols = existing.columns
    return keep_last(existing.withColumn("_p", F.lit(0)).unionByName(incoming.select(*cols).withColumn("_p", F.lit(1))),
                     keys, "_p").select(*cols)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove manifests but the newest `keep`, and writes that none of those names. Not while a job
    writes, or reads an older version."""
    if keep < 1:
        raise DataError("keep one version at least")
    found = versions(spark, path)
    used = {w for v in found[-keep:] for w in manifest(spark, path, v).values()}
    gone = [n for n in _names(spark, path) if n.startswith(f"{WRITE}=") and n[len(WRITE) + 1:] not in used]
    gone += [f"{MANIFESTS}/{v:012d}.json" for v in found[:-keep]]
    for name in gone:
        fs, p = _files(spark, f"{path}/{name}")
        fs.delete(p, True)
    return gone
