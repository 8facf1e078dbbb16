"""What the operators ask of the running session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, else the one given to `setCheckpointDir`.

    Only a local master, as in tests, may do without: a temporary folder is made then and removed when Python
    ends. On a cluster executors can't see each other's temporary folders, so ValueError is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_vellumdex_folder", None)
    if not made:
        folder = tempfile.mkdtemp(prefix="vellumdex-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        made = spark._vellumdex_folder = f"file://{folder}"
    return made


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Have what was written to `path` removed when the driver's JVM ends."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it again.

    Later jobs read the files, so a lost executor costs no recomputation of what led to them. The files stay as
    long as the driver's JVM, as results are lazy and read them.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
