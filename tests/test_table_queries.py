import pytest

import __spark_entry__ as entry_module
from tests.conftest import SMALL, TINY
from tidemark.plans import reading_queries, table_queries, tree_queries

PARTS = (table_queries, tree_queries, reading_queries)
QUERIES = {k: v for p in PARTS for k, v in p.queries().items()}
SQL = {k: v for p in PARTS for k, v in p.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) == sum(len(p.queries()) for p in PARTS)


def test_planted_cases_are_there(spark):
    """No query of the scan or of the readers agrees with its SQL only for having nothing to find."""
    kinds = lambda name, column: {r[column] for r in QUERIES[name](spark, SMALL).select(column).distinct().collect()}
    assert kinds("planted_rules", "rule_id") == kinds("planted_rules_joined", "rule_id") == {"home", "account", "pem", "key"}
    assert kinds("tree_issues", "kind") == {"high-risk file", "unapproved xlsx", "sensitive text"} and len(kinds("tree_issues", "detail")) == 5
    assert kinds("tree_status", "scan_status") == {"scanned", "unreadable", "skipped"}
    assert kinds("read_verdicts", "status") == {"pass", "missing", "mismatch", "unreadable", "engine_error"}
    assert kinds("script_fold_words", "found") == {True, False}


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert TINY != SMALL


def test_scan_reads_only_what_it_needs(spark):
    plan = table_queries.scan_issues(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Join" not in plan and "Exchange" not in plan


def test_small_sides_are_broadcast(spark):
    plan = table_queries.registry_lookup(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
