"""URL filters by a sort-merge range join, in DataFrame functions only.

A host is turned round label by label (`www.example.net` to `net.example.www.`), so that
a rule for a host and its subdomains is a prefix, and a prefix is an interval of the
sorted keys: from `net.example.` up to, but without, `net.example/` (`/` follows `.`).
Rules and URLs are sorted together in slices; a window carries the stack of the rule met
last, its enclosing rules below it, forward to the URLs behind it.  Intervals of prefixes
nest, so of the rules open at a URL each is in that stack; the ones that ended before the
URL are popped by their interval's end, and the longest whose path the URL has wins.

URLs are dealt over the slices by number, not by host: a host with a third of all rows is
spread like any other.  Each slice gets every rule; rules are an input of the operator
and do not grow with the URLs (`slices` times the rules is what the copying costs).

Nulls and edges: a null URL, or one without `://`, has an empty host and path, fits no
rule and gets the default verdict.  Of rules of the same length, host and path together,
the one with the longer host wins; of rules with the same host and path, block wins.
Repeated rows stay repeated.  A null rule host or path is an empty one; a rule with an
empty host fits nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "struct<reach:string,ends:string,path:string,name:string,verdict:string,size:int,host_size:int>"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as the table that `judge` takes."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _stacks(rules: DataFrame) -> DataFrame:
    """For each rule host its key and the stack there: its rules and those of the hosts around it."""
    host = lower_ascii(F.coalesce("host", F.lit("")))
    own = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("verdict").alias("verdict")).filter("host != ''")
    own = own.groupBy("host", "path").agg(F.min(F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("v"))
    own = own.select(reversed_key(F.col("host")).alias("key"), "host", "path", F.when(F.col("v") == 0, "block").otherwise("allow").alias("verdict"))
    entry = F.struct(
        F.col("key").alias("reach"), F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("ends"), F.col("path"),
        F.concat("host", "path").alias("name"), F.col("verdict"), (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
    )
    at_host = own.groupBy("key").agg(F.collect_list(entry).alias("rules"))
    # a key's enclosing keys are its prefixes that end in a dot: a few, whatever the number of rules
    labels = F.split(F.expr("left(key, length(key) - 1)"), "[.]")
    around = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))
    met = at_host.select("key", F.explode(around).alias("outer"))
    return met.join(at_host.select(F.col("key").alias("outer"), "rules"), "outer").groupBy("key").agg(F.flatten(F.collect_list("rules")).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", slices: int | None = None) -> DataFrame:
    """One row per row: id, host, path, rule (the winning rule's host and path, or null), verdict."""
    spark = urls.sparkSession
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(f"`{url_col}`").cast("string")
    pages = urls.select(F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int").alias("slice"), F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    pages = pages.select("slice", reversed_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast(f"array<{_RULE}>").alias("stack"))
    stacks = _stacks(rules).select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "key", "stack")
    starts = stacks.select("slice", "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema[id_col].dataType).alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    sweep = W.partitionBy("slice").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = pages.unionByName(starts).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    open_ = F.filter("stack", lambda r: (F.col("key") >= r["reach"]) & (F.col("key") < r["ends"]) & F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(open_, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    out = swept.withColumn("best", best)
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
