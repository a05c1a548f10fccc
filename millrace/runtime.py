"""Session helpers shared by every operator: table access, shipping the package to
the executors, and tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


#: Tables whose rows cost much more to work on than to read.
TEXT_TABLES = frozenset({"documents", "chunks", "records", "call_turns"})
#: A table of at most so many bytes may be dealt out to more tasks than its files have row groups.
SPREAD_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory; a tiny text table of few splits is spread."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than half the cores and at most SPREAD_BYTES is dealt out to all cores;
    any larger one is left as the scan cuts it, so that what is shuffled here has a fixed bound. Filters
    and columns are still pushed into the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() * 2 < cores
    return df.repartition(cores) if few and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES else df


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per application)."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_PACKAGE.rglob("*")):
            if path.suffix in {".py", ".json"}:
                archive.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    context._millrace_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one is set only where the session has none."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
    context.setCheckpointDir(made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: its lineage is cut, it is
    computed once, and it outlives any executor."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"millrace-{spark.sparkContext.applicationId}", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows, else as it is: joins then shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Delete every table that materialize() wrote in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), f"millrace-{spark.sparkContext.applicationId}"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
