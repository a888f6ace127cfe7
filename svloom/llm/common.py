"""What the training-data operators share: input columns, the shared folder, bounds."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every internal column, so that extra columns of the input can't clash.
P = "__llm_"


def forget(df: DataFrame) -> None:
    """Removes the files of a saved DataFrame that is of no more use."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(name: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and all executors see.

    It lies in spark.checkpoint.dir; only where that is unset and all runs in one process (tests) a
    temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            base = jvm_dir.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="svloom-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def trim() -> None:
    """Hands a worker's freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Rows that go to a Python worker at once: texts may be long, and a batch is held several times over.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; the session hands texts to Python in small batches unless it was told of another size."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS) == "10000":
        conf.set(_ROWS, str(BATCH_ROWS))
    return df


#: Whether Spark drops a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut.

    What it was shuffled through is of no more use then, so those files go at once.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def key_bounds(df: DataFrame, key: str, parts: int, distinct: bool = True) -> np.ndarray:
    """At most parts - 1 ascending bounds that cut the key's rows into like parts; a key of many rows recurs unless distinct.

    Reads the key column alone; what reaches the driver is bounded by parts.
    """
    cuts = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(F.col(key).cast("long"), cuts, 10 * parts).alias("b")).first()["b"] if cuts else None
    found = np.asarray(got or [], dtype=np.int64)
    return np.unique(found) if distinct else found


def part_count(spark: SparkSession, least: int = 32, most: int = 4096) -> int:
    return min(most, max(least, int(spark.conf.get("spark.sql.shuffle.partitions"))))
