"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and 0x09-0x0D.
SPACES = r"[\x20\x09-\x0D]+"

#: Used only where the session names no shared folder, as in local tests.
FALLBACK_SCRATCH = "/tmp/checkpoints/fleetgauge"

#: A key counts as hot from this share of all rows on, so there are at most
#: ``1 / HOT_SHARE`` hot keys: the size bound of every broadcast made here.
HOT_SHARE = 1 / 1000

#: Folders that :func:`materialise` wrote, by application.
_WRITTEN: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``).

    Without that setting a local session uses a folder of its machine; on a
    cluster executors would not see each other's files there, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return FALLBACK_SCRATCH
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with a table that survives lost executors and that later
    branches read instead of computing it again.  :func:`clear_scratch` deletes
    these tables when the results that read them are written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing reads any more."""
    delete_folder(table.sparkSession, table.scratch_path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that the operators of this application have left in the shared folder."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        delete_folder(spark, path)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever signs their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and empty texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def hash_sample(keys: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``key``; the same in every run.

    A threshold on the hash first leaves little more than ``n`` rows to sort.
    """
    total = keys.count()
    if total <= n:
        return keys
    order = F.xxhash64(key)
    share = F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * n / total + 1e-6))
    return keys.where(share).orderBy(F.pmod(order, F.lit(1 << 30)), key).limit(n)


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``keyed`` (one row per key) without a hot task.

    ``weight`` is a column of ``keyed`` with the number of ``rows`` of its key
    and ``total`` the sum of it.  Keys with more than ``HOT_SHARE`` of all rows
    number at most ``1 / HOT_SHARE`` and are broadcast; the rest is shuffled,
    and there no key is large.  Both inputs are read twice: pass tables.
    """
    limit = max(total * HOT_SHARE, 1.0)
    hot = F.broadcast(keyed.where(F.col(weight) > limit))
    cold = keyed.where(F.col(weight) <= limit)
    columns = [c for c in keyed.columns if c != key]
    in_hot = rows.join(hot, key, "inner")
    names = F.broadcast(keyed.where(F.col(weight) > limit).select(key))
    in_cold = rows.join(names, key, "left_anti").join(cold, key, "left")
    order = [*rows.columns, *columns]
    return in_hot.select(order).unionByName(in_cold.select(order))
