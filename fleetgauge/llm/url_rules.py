"""URL filters as a sort-merge range join with a sweep.

A host's labels in reverse order, each followed by a dot, make a key in which
a rule's host and all its subdomains are one interval of keys with a common
prefix.  Rule starts and URLs are sorted together by key over range
partitions; the sweep carries along the stack of rules whose intervals the
last rule start lies in.  Intervals of prefixes are nested or disjoint, so the
rules active at a URL are those of that stack whose key is a prefix of the
URL's.  The part of the stack that is open where a partition begins comes from
the last rule start of the partitions before it (one row per partition).

URLs that share a host are spread over partitions by a hash behind the key.

Defined results: a null url or one without ``://`` has empty host and path and
fits no rule; of fitting rules the longest wins, then the longer host, then
the later text; without a fitting rule ``default`` decides; repeated rows get
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """Reversed labels, each with a dot behind it: ``example.org`` is ``org.example.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rules as a table of literals, without a Python serialiser."""
    listed = [F.struct(F.lit(verdict).alias("verdict"), F.lit(host).alias("host"), F.lit(path).alias("path")) for verdict, host, path in rules]
    return spark.range(1).select(F.inline(F.array(*listed)))


def rule_starts(rules: DataFrame) -> DataFrame:
    """(key, stack): per rule host the rules of it and of all hosts above it."""
    rule = F.struct(
        (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"),
        "path",
        key_of(F.col("host")).alias("key"),
        "verdict",
    )
    nodes = rules.select(key_of(F.col("host")).alias("key"), rule.alias("rule"))
    nodes = nodes.groupBy("key").agg(F.collect_set("rule").alias("rules"))
    labels = F.split(F.col("key"), r"\.")
    depth = F.size(labels) - 1
    above = F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    chain = nodes.select("key", F.explode(above).alias("above"))
    outer = nodes.select(F.col("key").alias("above"), "rules")
    return chain.join(outer, "above").groupBy("key").agg(F.flatten(F.collect_list("rules")).alias("stack"))


def sweep(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """``pages`` (with a column key) and the stack of rules active at each."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = starts.schema["stack"].dataType
    urls = pages.withColumn("stack", F.lit(None).cast(kind)).withColumn("order", F.struct(F.lit(1), F.xxhash64("page_id", "path")))
    rules = starts.select("key", "stack", F.struct(F.lit(0), F.lit(0).cast("long")).alias("order"))
    both = urls.unionByName(rules, allowMissingColumns=True)
    both = both.repartitionByRange(parts, "key", "order").withColumn("part", F.spark_partition_id())
    both = materialise(both, "url-sweep")
    last = both.where("stack is not null").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    # One row per range partition, also for those without a rule start.
    ends = both.groupBy("part").agg(F.lit(1).alias("one")).join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("stack", ignorenulls=True).over(before).alias("carried"))
    along = Window.partitionBy("part").orderBy("key", "order").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(along))
    swept = swept.where("order.col1 = 1").join(F.broadcast(carried), "part", "left")
    open_rules = F.coalesce("active", "carried", F.array().cast(kind))
    return swept.withColumn("active", F.filter(open_rules, lambda r: F.startswith(F.col("key"), r["key"])))


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    rules = rules_table(pages.sparkSession) if rules is None else rules
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    active = sweep(cut.withColumn("key", key_of(F.col("host"))), rule_starts(rules))
    best = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])))
    found = active.withColumn("best", best)
    verdict = F.coalesce(F.col("best.verdict"), F.lit(default))
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
