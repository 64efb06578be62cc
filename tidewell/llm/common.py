"""What the operators share: reading tables, the shared scratch folder, stored intermediates."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder. The path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose driver is its
    only executor gets one of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and every reader sees the same rows after an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """stored(), and how many rows there are."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get.get("n") or 0


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored() tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        base = shared_dir(spark).split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base in folder:  # never an input
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored. It does so when the driver's JVM collects
    garbage, which a driver that does little may put off while disks fill."""
    gc.collect()
    spark._jvm.System.gc()


#: Texts that go to a Python worker at a time, and their bytes (a longer text goes alone).
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The same rows, after the session's Arrow batches, which Spark counts in rows, are bounded for texts of any length."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the named columns; other columns are left alone. In bounded batches."""
    return bounded(df).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def parts(spark: SparkSession, rows: int, per_task: int) -> int:
    """How many partitions keep a task at per_task rows, and no fewer than the cores."""
    return max(int(spark.sparkContext.defaultParallelism), -(-rows // per_task))
