"""Cutting a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_ends: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Make ``checkpoint()`` usable; this application's own folder. The cluster's spark.checkpoint.dir is taken as it is; only a local master without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            master = sc.master
            if not (master.startswith("local") and not master.startswith("local-cluster")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ferrowick-")
        sc.setCheckpointDir(folder)
    own = sc.getCheckpointDir()
    if own not in _ends:  # below the folder set, by a name of this application's
        _ends.add(own)
        delete_at_end(spark, own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, where it survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut_lineage, by a Parquet table: compressed, and read by the columns that are wanted."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _place(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of any file system that Spark reaches."""
    system, path = _place(spark, folder)
    system.delete(path, True)


def copy_in(spark: SparkSession, local: str, name: str) -> str:
    """A file of the driver copied to a folder of any file system; its name there."""
    system, path = _place(spark, name)
    system.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), path)
    return name


def exists(spark: SparkSession, name: str) -> bool:
    system, path = _place(spark, name)
    return system.exists(path)


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Have a folder removed when the driver's JVM ends: what lies in it is of use to this application only."""
    system, path = _place(spark, folder)
    system.deleteOnExit(path)
