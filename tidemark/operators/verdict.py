"""Verdicts by element, with their evidence, and where they go.

Evidence has a row for each item and element, (item_id, element, executed,
column_resolved, region_found, readable, value); it never has what is expected.
Targets (item_id, subject) are joined only here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ELEMENTS, REVIEW_STATES, STATES
from ..sources.registry import small

#: Columns that steps which locate and read must not see.
EXPECTED = ("subject", "expected_subject", "target", "expected", "verdict", "status", "history")


def blind(items: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns, none of which may tell what is expected."""
    if told := [c for c in columns if c.lower() in EXPECTED]:
        raise ValueError(f"not for steps that read: {', '.join(told)}")
    return items.select(*columns)


def assert_blind(df: DataFrame) -> None:
    if told := [c for c in df.columns if c.lower() in EXPECTED]:
        raise ValueError(f"it has {', '.join(told)}")


def resolve(items: DataFrame, registry: DataFrame, key: str, column: str) -> DataFrame:
    """items with the registry's column for their key and `route`: reuse, or review where there is none."""
    known = registry.select(key, column).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(column).alias(column))
    return items.join(small(known), key, "left").withColumn("route", F.when(F.col(column).isNull(), "review").otherwise("reuse"))


def status_of(element: Column, executed: Column, resolved: Column, found: Column, readable: Column, value: Column, subject: Column) -> tuple[Column, Column]:
    """(status, layer): the first that holds; only a region that was looked for and isn't there is missing.

    Null flags count as false. The time element asks only whether its region
    shows; only the subject is compared with a target.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    differs = (element == "subject") & ~value.eqNullSafe(subject)
    rules = (
        (no(executed), "engine_error", "decompose"),
        (no(resolved), "engine_error", "map"),
        (no(found), "missing", "extract"),
        (no(readable) & (element != "time"), "unreadable", "extract"),
        (differs, "mismatch", "judge"),
    )
    status, layer = F.lit("pass"), F.lit("judge")
    for condition, state, where in reversed(rules):
        status, layer = F.when(condition, state).otherwise(status), F.when(condition, where).otherwise(layer)
    return status, layer


def judge(evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """(item_id, element, status, evidence(layer, source, value)), one row for each row of evidence."""
    want = targets.select("item_id", F.col("subject").alias("wanted_subject")).groupBy("item_id").agg(F.min("wanted_subject").alias("wanted_subject"))
    source = F.col("source") if "source" in evidence.columns else F.col("element")
    both = evidence.join(want, "item_id", "left")
    status, layer = status_of(F.col("element"), F.col("executed"), F.col("column_resolved"), F.col("region_found"), F.col("readable"), F.col("value"), F.col("wanted_subject"))
    return both.select("item_id", "element", status.alias("status"), F.struct(layer.alias("layer"), source.alias("source"), F.col("value").alias("value")).alias("evidence"))


def check_domain(verdicts: DataFrame) -> DataFrame:
    """verdicts, failing where a status or an element is outside of its domain or evidence is missing."""
    fine = F.col("status").isin(*STATES) & F.col("element").isin(*ELEMENTS) & F.col("evidence").isNotNull()
    checked = F.when(fine, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("not a verdict: "), F.coalesce("status", F.lit("null")))))
    return verdicts.withColumn("status", checked)


def combined(verdicts: DataFrame) -> DataFrame:
    """One row for each item and element: the gravest status of several observations, with its evidence."""
    grave = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))
    worst = F.max_by(F.struct("status", "evidence"), F.struct(grave, F.col("evidence.layer"), F.col("evidence.source"), F.col("evidence.value")))
    return verdicts.groupBy("item_id", "element").agg(worst.alias("w")).select("item_id", "element", "w.status", "w.evidence")


def to_review(status: Column) -> Column:
    return status.isin(*REVIEW_STATES)


def review_queue(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(to_review(F.col("status")))


def decided(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(~to_review(F.col("status")))


def after_review(verdicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decided verdicts and reviewed ones together; decisions (item_id, element, status, reviewer) fill only what was in review.

    What nobody has decided yet keeps its status.
    """
    final = decisions.groupBy("item_id", "element").agg(F.max_by(F.struct("status", "reviewer"), F.struct("reviewer", "status")).alias("d"))
    looked_at = review_queue(verdicts).join(final, ["item_id", "element"], "left")
    by = F.coalesce(F.col("d.reviewer"), F.lit("nobody"))
    reviewed = looked_at.select("item_id", "element", F.coalesce("d.status", "status").alias("status"), "evidence", by.alias("decided_by"))
    return decided(verdicts).withColumn("decided_by", F.lit("rules")).unionByName(reviewed)


def attribution(verdicts: DataFrame) -> DataFrame:
    """(layer, status, n)."""
    return verdicts.groupBy(F.col("evidence.layer").alias("layer"), "status").agg(F.count("*").alias("n"))


def wide(verdicts: DataFrame, elements: Iterable[str] = ELEMENTS) -> DataFrame:
    """One row for each item with a status for each element, never an overall one."""
    return verdicts.groupBy("item_id").pivot("element", list(elements)).agg(F.first("status"))
