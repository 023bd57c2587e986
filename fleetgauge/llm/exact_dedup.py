"""Exact deduplication over a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the
normalised text.  A batch of documents is reduced to one row per digest, a
sort-merge anti-join against the index finds the digests that are new, and
those are appended.  Only DataFrame functions run on the rows.

The number of buckets and the current data folder are rows of a small log next
to the data, so an index is read back the way it was written, whatever the
session's settings.  A batch has a name: adding it again, after a failure or by
mistake, adds what is still missing and gives the same answers.
:meth:`DigestIndex.compact` rewrites the index with one sorted file per bucket.

Defined results: a null text counts as empty; of equal texts the smallest
``doc_id`` stays, a null id only when no row has one; rows that repeat id and
text count as copies too, and one of them stays; an empty batch leaves the
index as it is; other columns of the input, whatever their names, are ignored
by :func:`annotate` and passed on by :func:`drop_copies`.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm.common import SPACES, columns_of, delete_folder, hot_join, materialise, scratch_dir

DIGEST = "text_sha256"


def digests_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row_id, raw_hash, text_sha256) of each row, as a table.

    ``row_id`` tells repeated rows apart; it is fixed by writing the table once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_id"),
        F.xxhash64(F.col("text")).alias("raw_hash"),
        F.sha2(F.regexp_replace(text, SPACES, " "), 256).alias(DIGEST),
    )
    return materialise(rows, "digests")


class DigestIndex:
    """Digests seen so far, with the document that stands for each of them.

    ``path`` is a folder all executors share; an index found there is reused
    with its own number of buckets, and asking for another number is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        found = self._log()
        if found is None:
            found = (0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
            self._note(*found)
        elif buckets not in (None, found[1]):
            raise ValueError(f"the index at {path} has {found[1]} buckets, not {buckets}")
        self._open(*found)

    def _log(self) -> tuple[int, int] | None:
        """Last version of the data and its number of buckets; None without an index."""
        try:
            last = self.spark.read.parquet(f"{self.path}/log").agg(F.max(F.struct("version", "buckets")).alias("x")).first()["x"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return (last["version"], last["buckets"])

    def _note(self, version: int, buckets: int) -> None:
        self.spark.range(1).select(F.lit(version).alias("version"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _open(self, version: int, buckets: int) -> None:
        self.version, self.buckets = version, buckets
        self.data = f"{self.path}/data-{version}"
        self.name = self._create(self.data)

    def _create(self, folder: str) -> str:
        name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({DIGEST} STRING, keep_id BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {self.buckets} BUCKETS "
            f"LOCATION '{folder}'"
        )
        return name

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame, name: str, folder: str) -> None:
        dealt = rows.select(DIGEST, "keep_id", "batch").repartition(self.buckets, DIGEST)
        dealt.write.bucketBy(self.buckets, DIGEST).sortBy(DIGEST).mode("append").saveAsTable(name, format="parquet", path=folder)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the digests of ``groups`` that the index does not hold yet."""
        new = groups.join(self.rows().hint("merge"), DIGEST, "left_anti")
        self._append(new.withColumn("batch", F.lit(batch)), self.name, self.data)

    def compact(self) -> None:
        """Rewrite the index with one sorted file per bucket.

        The new data become current by one row in the log; until then, and if
        the rewrite fails, the old data are.
        """
        version, old, data = self.version + 1, self.name, self.data
        folder = f"{self.path}/data-{version}"
        delete_folder(self.spark, folder)  # of a rewrite that failed
        # As plain files: over a bucketed scan the planner would leave out the repartitioning.
        rows = self.spark.read.schema(self.rows().schema).parquet(data)
        self._append(rows, self._create(folder), folder)
        self._note(version, self.buckets)
        self._open(version, self.buckets)
        self.spark.sql(f"DROP TABLE {old}")
        delete_folder(self.spark, data)

    def drop(self) -> None:
        """Delete the index with its data."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_folder(self.spark, self.path)


def _resolve(docs: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """The digests with keep_id, group_size and kept; without an index, one is made for this batch alone."""
    spark = docs.sparkSession
    own = index or DigestIndex(spark, f"{scratch_dir(spark)}/digest-index-{uuid.uuid4().hex}")
    batch = batch or uuid.uuid4().hex
    digests = digests_of(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id")))
    groups = digests.groupBy(DIGEST).agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(DIGEST, F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row"), "group_size")
    own.add(groups, batch)
    known = groups.drop("keep_id").join(own.rows().hint("merge"), DIGEST)
    mine = F.when(F.col("batch") == batch, F.col("keep_row"))
    known = materialise(known.select(DIGEST, "group_size", "keep_id", mine.alias("keep_row")), "digest-groups")
    if index is None:
        own.drop()
    found = hot_join(digests, known, DIGEST, "group_size", digests.count())
    return found.withColumn("kept", F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)))


def annotate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``batch`` names this batch in the index; a batch of that name that was
    added before, whole or in part, counts as this one.
    """
    found = _resolve(docs, index, batch)
    return found.select("doc_id", "keep_id", "group_size", "kept", DIGEST)


def take(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``stays`` (doc_id, raw_hash, n) names, with all their columns.

    Rows are matched by id and raw text hash; where such a row occurs more than
    once (``n``), one of them is taken.
    """
    same = stays.select(F.col("doc_id").alias("__fg_id"), F.col("raw_hash").alias("__fg_raw"), F.col("n").alias("__fg_n"))
    same = materialise(same, "kept")
    columns = columns_of(docs)
    rows = docs.select(*columns, F.xxhash64(F.col("text")).alias("__fg_text"))
    stay = rows.join(same, F.col("doc_id").eqNullSafe(F.col("__fg_id")) & (F.col("__fg_text") == F.col("__fg_raw")))
    once = stay.where("__fg_n = 1").select(columns)
    if same.where("__fg_n > 1").isEmpty():
        return once
    repeated = stay.where("__fg_n > 1").groupBy("__fg_id", "__fg_raw").agg(F.first(F.struct(*columns)).alias("__fg_row"))
    return once.unionByName(repeated.select("__fg_row.*"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = _resolve(docs, index, batch)
    same = found.groupBy("doc_id", "raw_hash").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    return take(docs, same.where("kept"))
