"""The release scan of a file tree: listing, tests of paths, reading, rules, issues, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import APPROVED_SHEETS, HIGH_RISK_SUFFIXES, SHEET_SUFFIX
from ..functions.paths import excluded, is_text, suffix
from ..sources.tree import decoded, list_tree, read_contents
from .rules import Rule, match_rules

PASSED = "PASS"
FAILED = "FAIL"
#: Lines of a report that is one text, at most; write_report() has all of them.
REPORT_LINES = 100_000


def scannable(files: DataFrame, own_path: str | None = None) -> DataFrame:
    return files.filter(~excluded(F.col("rel"), own_path))


def risky_files(files: DataFrame) -> DataFrame:
    """files whose suffix is one of those that shouldn't be published."""
    return files.filter(suffix(F.col("rel")).isin(*HIGH_RISK_SUFFIXES))


def unapproved_sheets(files: DataFrame, approved: tuple[str, ...] = APPROVED_SHEETS) -> DataFrame:
    """files that are sheets and whose whole path, which is case-sensitive, isn't approved."""
    allow = files.sparkSession.createDataFrame([(a,) for a in approved], "rel string")
    return files.filter(suffix(F.col("rel")) == SHEET_SUFFIX).join(F.broadcast(allow), "rel", "left_anti")


def suffix_issues(files: DataFrame, approved: tuple[str, ...] = APPROVED_SHEETS) -> DataFrame:
    """(rel, ord, kind, detail) of files that their suffix alone makes issues."""
    risky = risky_files(files).select("rel", F.lit("high-risk file").alias("kind"))
    sheets = unapproved_sheets(files, approved).select("rel", F.lit("unapproved xlsx").alias("kind"))
    return risky.unionByName(sheets).select("rel", F.lit(-1).alias("ord"), "kind", F.lit(None).cast("string").alias("detail"))


def with_text(files: DataFrame, root: str) -> DataFrame:
    """(rel, text, scan_status) of the files whose text is to be read; text is null where it isn't strict UTF-8."""
    read = read_contents(files.filter(is_text(F.col("rel"))).select("rel"), root)
    texts = read.select("rel", decoded(F.col("content")).alias("text"))
    return texts.withColumn("scan_status", F.when(F.col("text").isNull(), "unreadable").otherwise("scanned"))


def text_issues(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    found = match_rules(texts.filter(F.col("text").isNotNull()), "text", rules, ["rel"])
    return found.select("rel", "ord", F.lit("sensitive text").alias("kind"), F.col("shown").alias("detail"))


def release_issues(spark: SparkSession, root: str, rules: list[Rule], own_path: str | None = None) -> DataFrame:
    """All issues (rel, ord, kind, detail) of the tree; each rule at most once a file, nothing else merged."""
    files = scannable(list_tree(spark, root), own_path)
    return suffix_issues(files).unionByName(text_issues(with_text(files, root), rules))


def scan_status(spark: SparkSession, root: str, own_path: str | None = None) -> DataFrame:
    """(rel, scan_status): scanned, unreadable or skipped, so that what gives no issue can be told apart."""
    files = scannable(list_tree(spark, root), own_path)
    skipped = files.filter(~is_text(F.col("rel"))).select("rel", F.lit("skipped").alias("scan_status"))
    return with_text(files, root).select("rel", "scan_status").unionByName(skipped)


def rendered(issues: DataFrame) -> DataFrame:
    """issues with `line`, as a report shows them."""
    return issues.withColumn("line", F.concat(F.col("kind"), F.lit(": "), F.col("rel"), F.coalesce(F.concat(F.lit(" / "), F.col("detail")), F.lit(""))))


def report(issues: DataFrame, order: tuple[str, ...] = ("rel", "ord"), most: int = REPORT_LINES) -> DataFrame:
    """One row (verdict, n_issues, report), also if there is no issue. issues has line and the order's columns.

    report has the first `most` lines, so the one row is bounded; n_issues counts all.
    """
    first = issues.select(*order, "line").orderBy(*order, "line").limit(most)
    lines = F.array_sort(F.collect_list(F.struct(*order, "line")))
    text = first.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))
    counted = issues.agg(F.count("*").alias("n_issues"))
    # Two rows, one of each.
    return counted.join(F.broadcast(text)).select(F.when(F.col("n_issues") > 0, FAILED).otherwise(PASSED).alias("verdict"), "n_issues", "report")


def write_report(issues: DataFrame, path: str, order: tuple[str, ...] = ("rel", "ord")) -> None:
    """All lines in order, as text files whose names are in that order too."""
    issues.orderBy(*order, "line").select("line").write.text(path)


def main(argv: list[str], candidates: list[str | None] | None = None) -> int:
    """Scan the tree argv[0] (argv[1]: the scanner's own path in it); 1 if there are issues. candidates replace this machine's account names."""
    from .rules import default_rules

    spark = SparkSession.builder.getOrCreate()
    issues = release_issues(spark, argv[0], default_rules(spark, candidates), argv[1] if len(argv) > 1 else None)
    row = report(rendered(issues)).first()
    print(row["report"] if row["n_issues"] else f"release scan: {PASSED}")
    return int(row["n_issues"] > 0)


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
