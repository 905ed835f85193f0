"""URL rules by a sort-merge range join.

A host is turned round label by label, so that a host and all of its subdomains
are one interval of keys. Rules become the starts of such intervals; each start
carries the stack of rules that are active there, innermost first. Pages and
starts are sorted together, by ranges of keys; one sweep over each range then
gives each page the last start before it, and the page's own rule is the first in
that stack whose interval holds the page and whose path fits. What is active where
a range begins is carried to it from those before. Pages of one host are told
apart by a hash in the sort, so a host that holds a third of all pages takes as
many ranges as it needs, and no rule is copied but one stack a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, width

#: (host, path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    after = F.instr(url, "://")
    return F.when(after > 0, lower_ascii(F.regexp_extract(F.substr(url, after + 3), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    after = F.instr(url, "://")
    return F.when(after > 0, F.regexp_extract(F.substr(url, after + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by a dot: a prefix for all subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_starts(rules: DataFrame) -> DataFrame:
    """(key, stack): for each host with rules, its own and its parents' rules, innermost first.

    Of the rules of one host the longest path comes first; of equal rules block.
    """
    by_rank = (-F.length("path"), F.col("path"), F.when(F.col("verdict") == "block", 0).otherwise(1))
    rule = F.struct(*by_rank, F.concat("host", "path").alias("rule"), "verdict")
    named = rules.select(host_key(lower_ascii("host")).alias("key"), rule.alias("r"))
    hosts = named.groupBy("key").agg(F.array_sort(F.collect_set("r")).alias("own"))
    labels = F.split(F.expr("substr(key, 1, length(key) - 1)"), r"\.", -1)
    parent = lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit("."))
    parents = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), parent)).alias("parent"))
    shown = F.transform("own", lambda r: F.struct(*[r[n].alias(n) for n in ("path", "rule", "verdict")]))
    level = F.struct(-F.length("key"), F.col("key").alias("prefix"), shown.alias("rules"))
    outer = hosts.select(F.col("key").alias("parent"), level.alias("level"))
    return parents.join(outer, "parent").groupBy("key").agg(F.array_sort(F.collect_list("level")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url; other columns are ignored).

    rules has host, path, verdict. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest host wins, then the longest path. A
    null url, or one without ://, has an empty host and path, no rule and the
    default verdict. Repeated rows, and rows with a null page_id, are judged each;
    urls of any length are taken whole. An empty table gives an empty result; without
    rules every page has the default.
    """
    page = pages.select(F.col("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    tie, url = F.xxhash64("url", "page_id").alias("tie"), F.col("url")
    page = page.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), tie)
    starts = rule_starts(rules).select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), "stack")
    keyed = page.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "tie", "page_id", "host", "path")
    order = ("key", "kind", "tie")
    ranges = keyed.unionByName(starts, allowMissingColumns=True).repartitionByRange(width(pages.sparkSession), *order)
    events = materialize(ranges.withColumn("part", F.spark_partition_id()), "url-events")
    # One row a range: the last start in it, and from that the last one before each.
    ends = events.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    # Both are dealt by range already; nothing says how large a stack is, so it isn't broadcast.
    swept = swept.join(carried, "part").withColumn("active", F.coalesce("active", "carried"))
    holding = F.filter("active", lambda level: F.startswith(F.col("key"), level["prefix"]))
    fitting = F.filter(F.flatten(F.transform(holding, lambda level: level["rules"])), lambda r: F.startswith(F.col("path"), r["path"]))
    # Without any start before a page there is no stack at all.
    found = swept.withColumn("found", F.get(fitting, F.lit(0)))
    verdict = F.coalesce("found.verdict", F.lit(default))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
