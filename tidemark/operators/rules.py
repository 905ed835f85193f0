"""Ordered rule sets and their match against texts."""

from __future__ import annotations

import getpass
import os
import re
from collections.abc import Iterable
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import HOME_RULE, KEY_RULE, LEAST_NAME, PEM_RULE

RULES_SCHEMA = "ord int, rule_id string, shown string, pattern string, needs string"
#: Up to so many rules become literal patterns in one projection; more are joined.
UNROLLED = 50


class Rule(NamedTuple):
    """needs is a literal that every match has; texts without it are passed without the regex."""

    ord: int
    rule_id: str
    shown: str
    pattern: str
    needs: str = ""


def local_names() -> list[str | None]:
    """Account names of this machine, unfiltered; tests give their own."""
    try:
        user = getpass.getuser()
    except (OSError, KeyError):
        user = None
    return [user, os.environ.get("USER"), os.environ.get("LOGNAME"), Path.home().name]


def account_names(candidates: DataFrame, least: int = LEAST_NAME) -> DataFrame:
    """(name): distinct, of at least so many characters, by code point; nulls are left out."""
    return candidates.select("name").filter(F.length("name") >= least).distinct().orderBy("name")


def quoted(literal: str) -> str:
    """A java.util.regex pattern of the literal, in any case."""
    return "(?iu)\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def rule_list(names: Iterable[str]) -> list[Rule]:
    """Home paths, then account names in the given order, then keys."""
    found = [(*HOME_RULE, "/Users/"), *(("account", re.escape(n), quoted(n)) for n in names), (*PEM_RULE, "PRIVATE KEY-----"), KEY_RULE]
    return [Rule(i, *r) for i, r in enumerate(found)]


def default_rules(spark: SparkSession, candidates: Iterable[str | None] | None = None) -> list[Rule]:
    """The rules of this machine; candidates replace its account names."""
    given = spark.createDataFrame([(c,) for c in (local_names() if candidates is None else candidates)], "name string")
    # A handful of names.
    return rule_list(r["name"] for r in account_names(given).collect())


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(rules, RULES_SCHEMA)


def matches(text: Column, rules: list[Rule]) -> Column:
    """An array of (ord, rule_id, shown) of the rules that are found anywhere in the text, once each, in order."""
    if not rules:
        return F.array().cast("array<struct<ord:int,rule_id:string,shown:string>>")
    hit = lambda r: F.rlike(text, F.lit(r.pattern)) if not r.needs else F.contains(text, F.lit(r.needs)) & F.rlike(text, F.lit(r.pattern))
    each = [F.when(hit(r), F.struct(F.lit(r.ord).alias("ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.shown).alias("shown"))) for r in rules]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def match_rules(texts: DataFrame, text: str, rules: list[Rule], keep: list[str]) -> DataFrame:
    """(*keep, ord, rule_id, shown): one row for each text and rule that is found in it.

    A small rule set is evaluated in the scan's own projection, each literal
    pattern compiled once; a large one is a broadcast theta join, whose size is
    that of the list given.
    """
    if len(rules) <= UNROLLED:
        return texts.select(*keep, F.explode(matches(F.col(text), rules)).alias("found")).select(*keep, "found.*")
    tagged = texts.select(*keep, F.col(text).alias("searched_text"))
    return tagged.join(F.broadcast(rule_table(texts.sparkSession, rules)), F.contains("searched_text", F.col("needs")) & F.rlike("searched_text", F.col("pattern"))).select(*keep, "ord", "rule_id", "shown")

