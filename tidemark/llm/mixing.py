"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Texts are read once, for their sizes. Documents are dealt to blocks of their
source. A source's target is whole rounds of all its blocks and a last round of
blocks in permuted order, cut where the target is reached, so every source has an
exact quota of blocks. A tree splits the quotas among the output shards: at each
node its blocks stand in a drawn order, and the first part of them goes left, so
the left side's counts by source are a multivariate-hypergeometric draw and the
sums stay exact. A part of a drawn order is one itself, so one permutation serves
all nodes, and a node is a range of it. A shard's blocks are disjoint from all others'; within a
shard documents are ordered by a hash. What is planned is a few columns for each
block; a document finds its block by its hash, so no text is shuffled to decide
what is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Words of an output shard, about: its task reads some 30 MB.
SHARD_WORDS = 4_000_000
#: Documents of a block, about, and blocks of a source at most.
BLOCK_DOCS = 2048
MAX_BLOCKS = 4096
#: A plan of more rows is joined by a shuffle.
BROADCAST_ROWS = 100_000
SEED = 20


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def drawn(*parts: Column | int | str) -> Column:
    """A number below 2**60 that depends on the parts alone, in any engine; nulls are left out."""
    named = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *named)), 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df, written, with `number` from 0 in the given order; sorted by ranges, so no task has all rows."""
    placed = materialize(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33)
    # As many rows as a sort has partitions.
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    found = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("number", number)
    return found.drop("part", "start", "at")


def join_plan(left: DataFrame, plan: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    """Broadcast the plan where it has few rows, counted; else join by a shuffle."""
    return left.join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, on, how)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, docs, source_size, source_no, target) of sizes (source, docs, source_size).

    The level is raised until the sources below their cap take what the capped
    ones leave; each round reads one row of sums.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "mixing-sources")
    by_turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", by_turn).withColumn("cap", max_repeats * F.col("source_size")), "mixing-weights")
    total, level, before = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0, None
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        sums = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))))
        capped, taken, weight = sums.first()
        if capped == before or not weight:
            break
        level, before = (total - (taken or 0)) / weight, capped
    target = F.round(F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")), 6)
    ranked = ranked.withColumn("target", target).withColumnRenamed("number", "source_no")
    return materialize(ranked.select("source", "docs", "source_size", "source_no", "target"), "mixing-targets")


def mixing_plan(
    sized: DataFrame, weights: tuple[int, ...], shards: int | None, max_repeats: int, seed: int
) -> tuple[DataFrame, DataFrame, int]:
    """Plans by source and by block for sized (doc_id, source, size), and the number of shards."""
    sizes = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, max_repeats)
    wanted = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as long) div source_size")).otherwise(0)
    n_blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("int")
    sources = sources.withColumn("blocks", n_blocks).withColumn("rounds", whole)
    rest = (wanted - F.col("rounds") * F.col("source_size")).cast("long")
    sources = materialize(sources.withColumn("rest", rest), "mixing-quotas")

    if shards is None:
        shards = max(1, -(-(sources.agg(F.sum("source_size")).first()[0] or 0) // SHARD_WORDS))
    dealt = in_blocks(sized, sources, seed).select("source_no", "block", "order", "size", "rounds", "rest")
    blocks = materialize(dealt.groupBy("source_no", "block", "rounds", "rest").agg(F.sum("size").alias("words")), "mixing-blocks")
    # At most MAX_BLOCKS rows for each source.
    by_draw = Window.partitionBy("source_no").orderBy(drawn(seed, "source_no", "block"), "block")
    permuted = by_draw.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("need", F.col("rest") - F.coalesce(F.sum("words").over(permuted), F.lit(0)))
    mode = F.when(F.col("need") <= 0, "none").when(F.col("need") >= F.col("words"), "all").otherwise("cut")
    blocks = blocks.withColumn("mode", mode)
    blocks = materialize(blocks.withColumn("units", F.col("rounds") + (F.col("mode") != "none").cast("long")), "mixing-modes")

    # In the one block of a source that is cut: the place in its order where the target is reached.
    docs_of_cut = dealt.join(blocks.filter("mode = 'cut'").select("source_no", "block", "need"), ["source_no", "block"])
    by_order = docs_of_cut.groupBy("source_no", "block", "need", "order").agg(F.sum("size").alias("words"), F.count("*").alias("same"))
    running = Window.partitionBy("source_no", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    by_order = by_order.withColumn("left", F.col("need") - F.coalesce(F.sum("words").over(running), F.lit(0)))
    cut_words = F.expr("left div same").alias("cut_words")
    cuts = by_order.filter("left > 0 and left <= words").select("source_no", "block", F.col("order").alias("cut_at"), cut_words)

    units = blocks.filter("units > 0").select("source_no", "block", F.explode(F.sequence(F.lit(1), F.col("units"))).alias("round"))
    parts = F.array_sort(F.collect_list(F.struct("round", "shard"))).alias("parts")
    of_block = split_units(units, shards, seed).groupBy("source_no", "block").agg(parts)
    plan = blocks.select("source_no", "block", "mode")
    for more in (cuts, of_block):
        plan = plan.join(more, ["source_no", "block"], "left")
    return sources, materialize(plan, "mixing-plan"), shards


def split_units(units: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Add shard (0..shards-1) to units (source_no, block, round), by the splitting tree.

    A node is the shards from low up to high and n units from number first on; its
    quota goes to both halves by their shards.
    """
    unit = ("source_no", "block", "round")
    ranked = numbered(units, [drawn(seed, *unit), *map(F.col, unit)], "mixing-tree")
    node = lambda low, high, first, n: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), first.cast("long").alias("first"), n.cast("long").alias("n"))

    def descend(at: Column, _: Column) -> Column:
        low, high, first, n = (at[c] for c in ("low", "high", "first", "n"))
        middle = F.floor((low + high) / 2)
        left = F.round(n * (middle - low) / (high - low))
        goes = F.col("number") - first < left
        return F.when(high - low == 1, at).when(goes, node(low, middle, first, left)).otherwise(node(middle, high, first + left, n - left))

    root = node(F.lit(0), F.lit(shards), F.lit(0), F.lit(ranked.count()))
    depth = (shards - 1).bit_length()
    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, descend) if depth else root
    return ranked.select(*unit, leaf["low"].alias("shard"))


def in_blocks(docs: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, ...) with their source's quotas, block and order in it."""
    known = sources.select(F.col("source").alias("of_source"), "source_no", "source_size", "target", "blocks", "rounds", "rest")
    out = join_plan(docs, known, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    block = (drawn(seed, "doc_id", "size") % F.col("blocks")).cast("int")
    return out.withColumn("block", block).withColumn("order", drawn(seed + 1, "doc_id", "size"))


def mix(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int | None = None, max_repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, rounds, last_words, shards) for each row of sized.

    sized has doc_id, source and size; other columns are ignored. Source n, by code
    point with null last, weighs weights[n mod len]; all sources together share the
    sum of all sizes. A target stops at max_repeats times its source's size, and the
    excess goes to the others by weight. taken is `rounds` times the size and the
    last_words of one more round; only one order value of a source is taken in part.
    shards has the shard of each round; there are as many as asked for, else one for
    SHARD_WORDS words. Rows that repeat doc_id and size are taken alike, and so are
    rows of one size with a null doc_id; they go to one block. Sources and documents
    without a word have target and taken 0. A document of any length is one unit of
    its block, so the largest bounds how even shards can be. An empty table gives an
    empty result. The same rows give the same mix, however they are partitioned.
    """
    sized = sized.select("doc_id", "source", "size")
    sources, plan, _ = mixing_plan(sized, weights, shards, max_repeats, seed)
    names = ["doc_id", "size", "source_size", "target", "taken", "rounds", "last_words", "shards"]
    return planned(sized, sources, plan, seed).select(*names)


def planned(docs: DataFrame, sources: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    placed = join_plan(in_blocks(docs, sources, seed), plan, ["source_no", "block"])
    before = F.when(F.col("order") < F.col("cut_at"), F.col("size")).when(F.col("order") == F.col("cut_at"), F.col("cut_words"))
    last = F.when(F.col("mode") == "all", F.col("size")).when(F.col("mode") == "cut", F.coalesce(before, F.lit(0))).otherwise(0)
    placed = placed.withColumn("last_words", last.cast("long"))
    placed = placed.withColumn("taken", F.col("rounds") * F.col("size") + F.col("last_words"))
    parts = F.coalesce("parts", F.array().cast("array<struct<round:bigint,shard:int>>"))
    used = F.filter(parts, lambda p: (p["round"] <= F.col("rounds")) | (F.col("last_words") > 0))
    shards = F.when(F.col("size") > 0, F.transform(used, lambda p: p["shard"]))
    return placed.withColumn("shards", F.coalesce(shards, F.array().cast("array<int>")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])", -1), F.lit(1), n.cast("int")), "")


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int | None = None, max_repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """The mix itself: a row of docs for each time it is taken, dealt to shards and shuffled within them.

    A row that is taken in part has the first words of its text; n_chars, where
    docs has it, follows the text. Other columns go through. shards defaults to one
    for SHARD_WORDS words. Rows without a word, null texts among them, aren't taken.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(F.col("text")).alias("size"), "text", row)
    small = materialize(sized.select("doc_id", "source", "size"), "mixing-sizes")
    sources, plan, shards = mixing_plan(small, weights, shards, max_repeats, seed)
    copy = F.posexplode("shards").alias("copy", "shard")
    copies = planned(sized, sources, plan, seed).select("doc_id", "row", "text", "rounds", "size", "last_words", copy)
    part = (F.col("copy") >= F.col("rounds")) & (F.col("last_words") < F.col("size"))
    copies = copies.withColumn("text", F.when(part, first_words(F.col("text"), F.col("last_words"))).otherwise(F.col("text")))
    # A shard is a partition: no sample of the rows is needed to deal them.
    mixed = copies.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return mixed.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in names])
