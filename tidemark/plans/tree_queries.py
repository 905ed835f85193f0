"""The release scan as queries, over trees and texts that are made from the tables.

Every page becomes a file, at a path by its number, with its html as content; by
their numbers too, some have what the rules look for. The SQL gives the same rows
from the same expressions and plain forms of the tests.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import rules, scan
from ..sources import tree
from ..sources.shared import new_path

OWN_PATH = "tools/own.py"
#: Account names as a machine may give them: repeated, missing, too short, with a mark of patterns.
CANDIDATES = ("alice", "bob.smith", "alice", None, "", "al")
#: More rules than go into one projection.
MANY = ("alice", *(f"nobody-{i:02}" for i in range(60)))

# Valid in both dialects. What looks like a credential is put together from parts, so that no file of the
# repository holds one.
_PLANTED = """
  || CASE WHEN {id} % 5 = 0 THEN ' /Users' || '/bob/ ' ELSE '' END
  || CASE WHEN {id} % 7 = 0 THEN ' xxALICExx ' ELSE '' END
  || CASE WHEN {id} % 8 = 0 THEN ' -----BEGIN RSA PRIVATE' || ' KEY----- ' ELSE '' END
  || CASE WHEN {id} % 9 = 0 THEN ' AK' || 'IA' || 'ABCDEFGH01234567 ' WHEN {id} % 9 = 1 THEN ' xAK' || 'IA' || 'ABCDEFGH01234567 ' ELSE '' END
"""
_REL = f"""CASE WHEN page_id = 24 THEN '{OWN_PATH}' WHEN page_id = 3 THEN '{fixed.APPROVED_SHEETS[0]}' ELSE CASE page_id % 12
  WHEN 0 THEN 'site/p' || CAST(page_id AS STRING) || '.md' WHEN 1 THEN 'site/deep/er/P' || CAST(page_id AS STRING) || '.HTML'
  WHEN 2 THEN 'docs/r' || CAST(page_id AS STRING) || '.docx' WHEN 3 THEN 'data/t' || CAST(page_id AS STRING) || '.xlsx'
  WHEN 4 THEN '.git/o' || CAST(page_id AS STRING) || '.txt' WHEN 5 THEN 'site/__pycache__/c' || CAST(page_id AS STRING) || '.py'
  WHEN 6 THEN 'd' || CAST(page_id AS STRING) || '/.gitignore' WHEN 7 THEN 'site/i' || CAST(page_id AS STRING) || '.png'
  WHEN 8 THEN '.github/w' || CAST(page_id AS STRING) || '.yml' WHEN 9 THEN 'bad/b' || CAST(page_id AS STRING) || '.txt'
  WHEN 10 THEN 'logs/a' || CAST(page_id AS STRING) || '.log' ELSE '_lead/n' || CAST(page_id AS STRING) END END"""
_TEXT = "html" + _PLANTED.format(id="page_id")
#: Files that aren't valid UTF-8.
_BAD = "page_id % 12 = 9"
_DOCUMENT = "text" + _PLANTED.format(id="doc_id")

#: Roots of trees that are written already, by application and tables.
_roots: dict[tuple[str, str], str] = {}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def page_tree(spark: SparkSession, sf_dir: str) -> str:
    """The root of a tree with a file for each page; written once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _roots or not os.path.isdir(_roots[key].removeprefix("file://")):
        root = new_path(spark, "trees/pages")
        mark = F.expr(f"CASE WHEN {_BAD} THEN X'FFFE' ELSE X'' END")
        content = F.concat(mark, F.encode(F.expr(_TEXT), "UTF-8"))
        tree.write_tree(_pages(spark, sf_dir).select(F.expr(_REL).alias("rel"), content.alias("content")), root)
        _roots[key] = root
    return _roots[key]


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.list_tree(spark, page_tree(spark, sf_dir))


def tree_scannable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scannable(tree_listing(spark, sf_dir), OWN_PATH).select("rel")


def tree_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = scan.with_text(scan.scannable(tree_listing(spark, sf_dir), OWN_PATH), page_tree(spark, sf_dir))
    return texts.select("rel", "scan_status", F.md5("text").alias("text_md5"))


def tree_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_status(spark, page_tree(spark, sf_dir), OWN_PATH)


def tree_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.release_issues(spark, page_tree(spark, sf_dir), rules.default_rules(spark, CANDIDATES), OWN_PATH)


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.rendered(tree_issues(spark, sf_dir)).select("rel", "line")


def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.report(scan.rendered(tree_issues(spark, sf_dir)))


def rule_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_table(spark, rules.default_rules(spark, CANDIDATES)).select("ord", "rule_id", "shown")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_DOCUMENT).alias("text"))


def planted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.match_rules(_documents(spark, sf_dir), "text", rules.rule_list(["alice"]), ["doc_id"])
    return found.select("doc_id", "ord", "rule_id")


def planted_rules_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with so many rules that they are joined as a table."""
    found = rules.match_rules(_documents(spark, sf_dir), "text", rules.rule_list(MANY), ["doc_id"])
    return found.select("doc_id", "ord", "rule_id")


def membership_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.risky_files(_pages(spark, sf_dir).select("page_id", F.expr(_REL).alias("rel"))).select("page_id", "rel")


def allowlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.unapproved_sheets(_pages(spark, sf_dir).select("page_id", F.expr(_REL).alias("rel"))).select("page_id", "rel")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            tree_listing, tree_scannable, tree_contents, tree_status, tree_issues, tree_lines, tree_report, rule_order, planted_rules,
            planted_rules_joined, membership_semi, allowlist_anti,
        )
    }


def _listed(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


_FILES = f"""
WITH f AS (
  SELECT page_id, rel, text, bad, lower(regexp_extract(rel, '(?s)^.*[^/](\\.[^./]+)$', 1)) AS suffix, regexp_extract(rel, '[^/]*$', 0) AS name
  FROM (SELECT page_id, {_REL} AS rel, {_TEXT} AS text, {_BAD} AS bad FROM pages) AS p
), s AS (
  SELECT * FROM f WHERE NOT list_has_any(string_split(rel, '/'), ['.git', '__pycache__']) AND rel <> '{OWN_PATH}'
), t AS (
  SELECT * FROM s WHERE suffix IN ({_listed(fixed.TEXT_SUFFIXES)}) OR name = '.gitignore'
), r AS (
  SELECT * FROM (VALUES (0, '/Users/[^/\\s]+/', '/Users/[^/\\s]+/'), (1, 'alice', '(?i)alice'), (2, 'bob\\.smith', '(?i)bob\\.smith'),
    (3, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----', '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'),
    (4, '\\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\\b', '\\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\\b')) AS v(ord, shown, pattern)
), i AS (
  SELECT rel, -1 AS ord, 'high-risk file' AS kind, CAST(NULL AS VARCHAR) AS detail FROM s WHERE suffix IN ({_listed(fixed.HIGH_RISK_SUFFIXES)})
  UNION ALL SELECT rel, -1, 'unapproved xlsx', NULL FROM s WHERE suffix = '.xlsx' AND rel <> '{fixed.APPROVED_SHEETS[0]}'
  UNION ALL SELECT t.rel, r.ord, 'sensitive text', r.shown FROM t JOIN r ON regexp_matches(t.text, r.pattern) WHERE NOT t.bad
), l AS (
  SELECT rel, ord, kind || ': ' || rel || CASE WHEN detail IS NULL THEN '' ELSE ' / ' || detail END AS line FROM i
)
"""


def _planted_sql(more: int) -> str:
    patterns = {(0, "home"): "/Users/[^/\\s]+/", (1, "account"): "(?i)alice", (2 + more, "pem"): "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", (3 + more, "key"): "\\b(?:AKIA|ASIA)[A-Z0-9]{16}\\b"}
    each = (f"SELECT doc_id, CAST({n} AS INTEGER) AS ord, '{rule}' AS rule_id FROM d WHERE regexp_matches(text, '{pattern}')" for (n, rule), pattern in patterns.items())
    return f"WITH d AS (SELECT doc_id, {_DOCUMENT} AS text FROM documents) " + " UNION ALL ".join(each)


def oracle_sql() -> dict[str, str]:
    return {
        "tree_listing": f"{_FILES} SELECT rel, CAST(strlen(text) + CASE WHEN bad THEN 2 ELSE 0 END AS BIGINT) AS size FROM f",
        "tree_scannable": f"{_FILES} SELECT rel FROM s",
        "tree_contents": f"{_FILES} SELECT rel, CASE WHEN bad THEN 'unreadable' ELSE 'scanned' END AS scan_status, CASE WHEN NOT bad THEN md5(text) END AS text_md5 FROM t",
        "tree_status": f"{_FILES} SELECT s.rel, CASE WHEN t.rel IS NULL THEN 'skipped' WHEN t.bad THEN 'unreadable' ELSE 'scanned' END AS scan_status FROM s LEFT JOIN t ON s.rel = t.rel",
        "tree_issues": f"{_FILES} SELECT rel, CAST(ord AS INTEGER) AS ord, kind, detail FROM i",
        "tree_lines": f"{_FILES} SELECT rel, line FROM l",
        "tree_report": f"{_FILES} SELECT CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS n_issues, coalesce(string_agg(line, chr(10) ORDER BY rel, ord, line), '') AS report FROM l",
        "rule_order": """SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'home', '/Users/[^/\\s]+/'), (1, 'account', 'alice'), (2, 'account', 'bob\\.smith'),
            (3, 'pem', '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'), (4, 'key', '\\b(?:AKIA|ASIA)[A-Z0-9]{16}\\b')) AS v(ord, rule_id, shown)""",
        "planted_rules": _planted_sql(0),
        "planted_rules_joined": _planted_sql(len(MANY) - 1),
        "membership_semi": f"{_FILES} SELECT page_id, rel FROM f WHERE suffix IN ({_listed(fixed.HIGH_RISK_SUFFIXES)})",
        "allowlist_anti": f"{_FILES} SELECT page_id, rel FROM f WHERE suffix = '.xlsx' AND rel NOT IN ({_listed(fixed.APPROVED_SHEETS)})",
    }
