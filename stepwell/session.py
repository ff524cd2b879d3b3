"""A session with the settings the engine is tuned for, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow batches of bounded size; `conf` overrides."""
    builder = SparkSession.builder.master(master).appName("stepwell").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where none is set one is made, but on one machine only, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            where = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stepwell-"))
            where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return where.rstrip("/")


def files_of(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path, whatever store it is in."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, gone when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stepwell/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = files_of(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, parts) -> int:
    """One file in any store, from an iterator of byte strings; memory is one of them.  Returns its size."""
    files, at = files_of(spark, path)
    out, size = files.create(at, True), 0
    try:
        for part in parts:
            out.write(bytearray(part))
            size += len(part)
    finally:
        out.close()
    return size
