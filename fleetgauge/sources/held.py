"""Tables that an analysis writes once and reads for all of its results.

They lie in the shared folder that ``spark.checkpoint.dir`` names, so they
survive lost executors and cut the lineage; without that setting only local
sessions have a folder of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no shared folder.
LOCAL_FOLDER = "/tmp/checkpoints/fleetgauge-held"

#: Folders that :func:`hold` wrote, by application.
_HELD: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a cluster without it an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        return LOCAL_FOLDER
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def hold(df: DataFrame, name: str = "held") -> DataFrame:
    """``df`` written as Parquet and read back; :func:`release` deletes it.

    The planner goes by the size of the files, and records of a few megabytes
    can hold millions of rows; so what is made of a held table is joined by
    merging, never broadcast through the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _HELD.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def release(spark: SparkSession) -> None:
    """Delete all held tables of this application, once the results that read them are written."""
    for path in _HELD.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
