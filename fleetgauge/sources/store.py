"""Versions of analysis results: tables first, then one manifest that makes them count.

A run writes its result tables into a folder of its own.  Nothing reads that
folder until a commit names it: a numbered file that is created only if it
isn't there yet.  So a lost executor, a rerun or a crash between two tables
leaves the old versions as they were, and two writers never get the same number;
the later one numbers its tests anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "test_id long, version int, author string, run string"


class Store:
    """Result tables under ``root``, a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        self._system = self._path(self.root).getFileSystem(self._conf)

    def commits(self, kind: str) -> list[tuple[int, str]]:
        """(number, run) of all commits in order: one small row per commit."""
        folder = f"{self.root}/commits/{kind}"
        if not self._system.exists(self._path(folder)):
            return []
        rows = self.spark.read.schema("value string").text(folder).select(F.col("_metadata.file_name").alias("n"), "value").collect()
        return sorted((int(r["n"]), r["value"]) for r in rows)

    def versions(self, kind: str) -> DataFrame:
        """(test_id, version, author, run) of all committed versions."""
        paths = [f"{self._run(kind, run)}/manifest-{n}" for n, run in self.commits(kind)]
        return self.spark.read.schema(MANIFEST).parquet(*paths) if paths else self.spark.createDataFrame([], MANIFEST)

    def table(self, kind: str, name: str) -> DataFrame | None:
        """A result table with the version of every row's test; None before the first commit."""
        parts = []
        for n, run in self.commits(kind):
            rows = self.spark.read.parquet(f"{self._run(kind, run)}/{name}")
            named = self.spark.read.schema(MANIFEST).parquet(f"{self._run(kind, run)}/manifest-{n}")
            parts.append(rows.join(named.select("test_id", "version"), "test_id"))
        found = parts[0] if parts else None
        for part in parts[1:]:
            found = found.unionByName(part, allowMissingColumns=True)
        return found

    def latest(self, kind: str, name: str) -> DataFrame | None:
        """The rows of each test's last version."""
        rows = self.table(kind, name)
        last = self.versions(kind).groupBy("test_id").agg(F.max("version").alias("version"))
        return None if rows is None else rows.join(last, ["test_id", "version"], "left_semi")

    def publish(self, kind: str, tables: dict[str, DataFrame], tests: DataFrame, author: str = "auto", run: str | None = None) -> str:
        """Write ``tables`` (each with test_id) as the next versions of ``tests`` (test_id); returns the run.

        The same ``run`` can be published again, after a crash or by mistake:
        what it left is overwritten, and once committed nothing happens.
        """
        run = run or uuid.uuid4().hex
        if run in [r for _, r in self.commits(kind)]:
            return run
        folder = self._run(kind, run)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        tests.select("test_id").distinct().write.mode("overwrite").parquet(f"{folder}/tests")
        tests = self.spark.read.parquet(f"{folder}/tests")
        while True:
            done = self.commits(kind)
            n = done[-1][0] + 1 if done else 1
            known = self.versions(kind).groupBy("test_id").agg(F.max("version").alias("version"))
            numbered = tests.join(known, "test_id", "left").select("test_id", (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"), F.lit(author).alias("author"), F.lit(run).alias("run"))
            numbered.write.mode("overwrite").parquet(f"{folder}/manifest-{n}")
            if self._claim(kind, n, run):
                return run

    def _run(self, kind: str, run: str) -> str:
        return f"{self.root}/runs/{kind}/{run}"

    def _claim(self, kind: str, n: int, run: str) -> bool:
        """Make ``run`` commit number ``n``; False if another one already is.  The whole file appears at once, by a rename that never overwrites."""
        target = self._path(f"{self.root}/commits/{kind}/{n}")
        part = self._path(f"{self.root}/claims/{kind}-{n}-{run}")
        out = self._system.create(part, True)
        out.write(run.encode())
        out.close()
        self._system.mkdirs(target.getParent())
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.NONE
        try:
            self._files.rename(part, target, how)
        except Exception as e:
            if self._system.exists(target):
                self._system.delete(part, False)
                return False
            raise e
        return True


def history(store: Store, kind: str, test_id: int) -> DataFrame:
    """The versions of one test in order, with who made them."""
    return store.versions(kind).where(F.col("test_id") == test_id).select("version", "author", "run").orderBy("version")


def changed(versions: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``values`` (test_id, version, keys, value) whose value differs from that of the version before; ``versions`` (test_id, version) says which there are."""
    before = Window.partitionBy("test_id", *keys).orderBy("version")
    each = versions.select("test_id", "version").join(values.select("test_id", *keys).distinct(), "test_id").join(values, ["test_id", "version", *keys], "left")
    each = each.withColumn("before", F.lag(value).over(before)).withColumn("first", F.row_number().over(before) == 1)
    return each.where(~F.col("first") & ~F.col(value).eqNullSafe(F.col("before"))).select("test_id", "version", *keys, "before", F.col(value).alias("now"))
