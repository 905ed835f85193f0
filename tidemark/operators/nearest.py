"""Nearest registered layout by descriptor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in the descriptors of a block, which is one array in a row, about, and in all that are broadcast, at most.
BLOCK_CELLS = 64_000
BROADCAST_CELLS = 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of other lengths, with nulls, or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest_layout(items: DataFrame, assets: DataFrame, digits: int = 6) -> DataFrame:
    """(item_id, asset, score) for items (item_id, descriptor): the asset (asset, descriptor) with the highest cosine; ties go to the lesser asset.

    Items that no asset can be compared with have null asset and score; of rows that
    repeat an item_id the best holds. Any number of assets is compared, in blocks: a
    few are broadcast, more are joined by block and a salt of the items.
    """
    as_double = F.col("descriptor").cast("array<double>")
    n, longest = assets.agg(F.count("*"), F.max(F.size("descriptor"))).first()
    cells = n * max(1, longest or 1)
    blocks = max(1, -(-cells // BLOCK_CELLS))
    block = F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int").alias("block")
    dealt = assets.select(block, F.struct("asset", as_double.alias("descriptor")).alias("a")).groupBy("block").agg(F.collect_list("a").alias("assets"))
    asked = items.select("item_id", as_double.alias("descriptor"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    if cells <= BROADCAST_CELLS:
        paired = asked.join(F.broadcast(dealt), "block", "left")
    else:
        salts = max(8, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salted = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        paired = asked.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(salts)).cast("int")).join(salted, ["block", "salt"], "left")
    scored = F.transform("assets", lambda a: F.struct((-F.round(cosine(F.col("descriptor"), a["descriptor"]), digits)).alias("s"), a["asset"].alias("asset")))
    best = F.array_min(F.filter(scored, lambda x: x["s"].isNotNull()))
    each = paired.select("item_id", best.alias("best"))
    found = each.groupBy("item_id").agg(F.min("best").alias("best"))
    return found.select("item_id", F.col("best.asset").alias("asset"), (-F.col("best.s")).alias("score"))
