"""Tables that cut lineage: written once in the folder all executors share, then read as often as a plan needs them."""

from __future__ import annotations

import atexit
import gc
import itertools
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: After so many written tables the driver's JVM gives back freed native memory.
TRIM_EVERY = 4

_written = itertools.count(1)
_own: list[str] = []
_run = uuid.uuid4().hex


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the session's checkpoint folder; an own one only in local mode, where all tasks see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="genoweave-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def trimmed(spark: SparkSession) -> str:
    """Let the driver's JVM give back native memory that it has freed, which glibc keeps in each thread's arena otherwise; what the JVM says to it."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    call = jvm.java.lang.Class.forName("javax.management.MBeanServer")
    call = next(m for m in call.getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # an older JVM, or one without glibc
        return ""


def tidy(spark: SparkSession) -> None:
    """In long jobs: let the driver drop what no DataFrame refers to any more, with its shuffle files, broadcasts and plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def settled(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read back. A run's folder goes when its driver ends.

    batch_rows: rows that kernels in df's plan are sent at once, where these are large; the session's own number otherwise.
    """
    spark = df.sparkSession
    top = f"{shared_folder(spark)}/genoweave-{_run}"
    path = f"{top}/{tag}-{uuid.uuid4().hex}"
    usual = spark.conf.get(BATCH)
    try:
        if batch_rows:
            spark.conf.set(BATCH, min(batch_rows, int(usual)) if int(usual) > 0 else batch_rows)
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, usual)
    folder = spark._jvm.org.apache.hadoop.fs.Path(top)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if next(_written) % TRIM_EVERY == 0:
        trimmed(spark)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """df with out, the place of each row from 0 in order of by: range partitions are numbered apart and moved by the rows ahead of them.

    The ranges are written first, as another run of the same plan may draw other bounds. One row a range is ordered in one task.
    """
    ranges = settled(df.repartitionByRange(by).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = ranges.join(F.broadcast(sizes.select("__range", ahead.alias("__ahead"))), "__range")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1
    return moved.withColumn(out, (F.col("__ahead") + place).cast("bigint")).drop("__range", "__ahead")
