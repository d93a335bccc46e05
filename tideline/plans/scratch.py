"""Cutting lineage with written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a temporary folder serves a local master only: on a
    cluster, executors would not see each other's files, so that raises.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, _local_dirs[sc.applicationId], ignore_errors=True)
    return _local_dirs[sc.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it back.

    The result survives the loss of executors and its size is known to the
    planner, so that adaptive execution can choose joins by it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tideline-{name}-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def replace(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Materialize ``new``, then delete the scratch table ``old`` that it was made from: a step of a loop keeps one table."""
    out = materialize(new, name)
    discard(old)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            delete_folder(table.sparkSession, path)
            _written.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables that this process has written: for a driver that has used or stored the results it wanted."""
    for path in list(_written):
        delete_folder(spark, path)
        _written.discard(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
