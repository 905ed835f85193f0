"""A training corpus from raw documents, in five stages.

STAGES holds (name, function). Each function takes (spark, docs, sf_dir), where
docs is all that the stage before has kept, and returns a DataFrame; all but the
last return the columns of documents. run() applies them, and writes and rereads
each one's rows, so a lost executor costs at most the running stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, marks, materialize, release, so_far, split_marked, table
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import quality_filter
from tidemark.llm.queries import tokenizer

#: Not expressible: rolling hashes, signatures, a drawn mix and a sequential packing.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged alone; null and empty texts, with too few words, go."""
    return quality_filter(docs)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    return name + "_" * (1 + max(map(len, docs.columns)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; a text that loses all of its words goes.

    Null and empty texts stay as they are. Rows that repeat both doc_id and text
    count as one place and get the same text; null doc_ids come first.
    """
    lines, removed = unused(docs, "lines"), unused(docs, "removed")
    out = line_dedup(docs, counts=(lines, removed))
    emptied = (F.col(removed) > 0) & ~F.rlike("text", F.lit(f"[^{SPACE}]"))
    text_length = F.length("text").cast("long")
    return out.filter(~emptied).select(*[text_length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; of rows that repeat both doc_id and text, one.

    Rows without a doc_id are documents of their own, after all others, so they go
    where a document with an id is a near copy, and one of several stays. Null and
    empty texts are copies of nothing and stay. Only rows whose id may be that of a
    dropped or a repeated document are shuffled.
    """
    if not docs.filter("doc_id is null").isEmpty():
        return _keep_one_with_ids(docs)
    return _keep_one(docs)


def _keep_one_with_ids(docs: DataFrame) -> DataFrame:
    """_keep_one with numbers above all doc_ids for rows that have none, taken off again."""
    first = (docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0) + 1
    kind, nameless = docs.schema["doc_id"].dataType, unused(docs, "nameless")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(max(first, 0)) + F.monotonically_increasing_id())
    # Written, as the numbers of a second run could differ.
    named = materialize(docs.withColumn(nameless, F.col("doc_id").isNull()).withColumn("doc_id", number), "pipeline-named")
    own = F.when(~F.col(nameless), F.col("doc_id")).cast(kind).alias("doc_id")
    return _keep_one(named).select(*[own if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])


def _keep_one(docs: DataFrame) -> DataFrame:
    seen, rows, nth = unused(docs, "seen"), unused(docs, "rows"), unused(docs, "nth")
    by_id = near_dedup(docs).groupBy("doc_id").agg(F.every("kept").alias("kept"), F.count("*").alias("rows"))
    special = materialize(by_id.filter("not kept or rows > 1").toDF(seen, "kept", rows), "pipeline-special")
    sure, rest = split_marked(docs, "doc_id", marks(special, seen))
    rest = rest.join(special.filter("not kept").select(seen), F.col("doc_id").cast("long") == F.col(seen), "left_anti")
    if not special.filter(F.col("kept") & (F.col(rows) > 1)).isEmpty():
        same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")
        rest = rest.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).drop(nth)
    return sure.unionByName(rest)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken from each source up to its target, a row for each time; a null source is one, and rows without a word aren't taken."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids; null and empty texts are the end id alone, repeated rows are packed each."""
    return pack(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage has kept is written, and its own tables are deleted then."""
    docs, since = table(spark, sf_dir, "documents"), so_far()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, keep=docs, since=since)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
