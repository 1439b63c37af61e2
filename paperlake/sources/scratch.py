"""Cut points of long plans: Parquet files in the folder that the cluster shares, deleted when the driver ends."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This application's own folder inside the one that ``spark.checkpoint.dir`` names.

    Where that is unset a temporary folder stands in, on local masters only: elsewhere executors and driver would not see
    each other's files, so it is an error.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    own = f"{shared.rstrip('/')}/paperlake-{context.applicationId}"
    if own not in _FOLDERS:
        _FOLDERS.add(own)
        atexit.register(_forget, spark, own)
    return own


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  Spark has ended before; a local folder can still be deleted from here
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def kept(df: DataFrame, name: str = "kept", **options: str) -> DataFrame:
    """df written once and read back, for plans that read it several times; a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._paperlake_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by sorted shuffles, whatever its size is guessed at.

    The planner takes a file's bytes for the size of its rows. A written table that packs well, or what is exploded from it, then counts
    as small with millions of rows, and the driver would gather all of them to broadcast them.
    """
    return df.hint("merge")


def forget(df: DataFrame) -> None:
    """Delete a cut point that no later plan reads."""
    path = getattr(df, "_paperlake_path", None)
    if path is not None:
        delete(df.sparkSession, path)
