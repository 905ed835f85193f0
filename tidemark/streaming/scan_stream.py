"""Rules over a stream of texts.

Matching needs no state, so any trigger and output mode append work; issue
counts are per event-time window with a watermark, which bounds their state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import Rule, match_rules


def issues_stream(texts: DataFrame, text: str, rules: list[Rule], keep: list[str]) -> DataFrame:
    """match_rules over a stream; at most UNROLLED rules keep it a projection."""
    return match_rules(texts, text, rules, keep)


def issue_counts(issues: DataFrame, time: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, rule_id, n), complete once the watermark has passed a window."""
    counted = issues.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "rule_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "rule_id", "n")


def write_issues(issues: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, then stop; each issue is written once, also after a restart."""
    return issues.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
