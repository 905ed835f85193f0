"""The operators as queries over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, folding, paths
from ..operators import nearest, rules, scan, verdict
from ..sources import registry

#: (rule, pattern, a literal in all matches); the patterns are the same in both regex dialects.
TABLE_RULES = (
    ("home", r"/Users/[^/\s]+/", "/Users/"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    ("token", r'token = "[0-9a-f]{40}"', 'token = "'),
    ("license", r"[Ll]icensed under the [A-Z]", "icensed under the "),
    ("pem", fixed.PEM_RULE[1], "PRIVATE KEY-----"),
    ("key", fixed.KEY_RULE[1], ""),
)
SEARCHED = "All Rights RESERVED"
#: (table, id column, text column) of all tables with texts.
TEXT_TABLES = (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"), ("benchmark", "item_id", "text"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules() -> list[rules.Rule]:
    return [rules.Rule(i, name, pattern, pattern, needs) for i, (name, pattern, needs) in enumerate(TABLE_RULES)]


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*/([^?#]*)", 1)


def scan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.match_rules(_read(spark, sf_dir, "documents"), "text", _rules(), ["doc_id"]).select("doc_id", "ord", "rule_id")


def scan_issues_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        rules.match_rules(_read(spark, sf_dir, name).select(F.col(key).alias("item_id"), F.col(text).alias("text")), "text", _rules(), ["item_id"]).select(F.lit(name).alias("source_table"), "item_id", "ord", "rule_id")
        for name, key, text in TEXT_TABLES
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("sensitive text: "), F.col("doc_id").cast("string"), F.lit(" / "), F.col("rule_id"))
    return scan.report(scan_issues(spark, sf_dir).withColumn("line", line), ("doc_id", "ord"))


def scan_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return scan_issues(spark, sf_dir).agg(F.when(n > 0, scan.FAILED).otherwise(scan.PASSED).alias("verdict"), n.alias("n_issues"))


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("n_issues", "report")


def suffix_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", paths.suffix(path).alias("suffix"), paths.suffix_class(path).alias("class"))


def component_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", _path(F.col("url")).alias("rel"))
    return pages.filter(~paths.excluded(F.col("rel"), components=("fr", "de")))


def distinct_sorted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.account_names(_read(spark, sf_dir, "documents").select(F.col("source").alias("name")))


def literal_ci_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    searched = rules.Rule(0, "searched", SEARCHED, rules.quoted(SEARCHED))
    return rules.match_rules(_read(spark, sf_dir, "documents"), "text", [searched], ["doc_id", "lang"]).select("doc_id", "lang")


def _page_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that were seen with https, each with its least page as the column's key."""
    secure = _read(spark, sf_dir, "pages").filter(F.startswith("url", F.lit("https://")))
    return secure.select(_host(F.col("url")).alias("host"), "page_id").groupBy("host").agg(F.min("page_id").alias("column_key"))


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", _host(F.col("url")).alias("host"))
    return verdict.resolve(pages, _page_registry(spark, sf_dir), "host", "column_key").select("page_id", "host", "column_key", "route")


def _five_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), _host(F.col("url")).alias("host"), "html")
    known = verdict.resolve(pages, _page_registry(spark, sf_dir), "host", "column_key")
    regions = {"subject": "<title>", "time": '<div class="ad">', "result": "<article>"}
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("element"), F.contains("html", F.lit(mark)).alias("region_found"), (title if e == "subject" else F.lit(None).cast("string")).alias("value")) for e, mark in regions.items()])).alias("e")
    evidence = known.select("item_id", F.col("html").isNotNull().alias("executed"), F.col("column_key").isNotNull().alias("column_resolved"), F.contains("html", F.lit("</html>")).alias("readable"), each).select("item_id", "executed", "column_resolved", "readable", "e.*")
    targets = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("subject"))
    return verdict.check_domain(verdict.judge(evidence, targets))


def _flat(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("item_id", "element", "status", F.col("evidence.layer").alias("layer"), F.col("evidence.value").alias("value"))


def five_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_five_verdicts(spark, sf_dir))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(verdict.review_queue(_five_verdicts(spark, sf_dir)))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(verdict.decided(_five_verdicts(spark, sf_dir)))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.attribution(_five_verdicts(spark, sf_dir))


def after_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers have passed the subjects in review of items with an even id."""
    verdicts = _five_verdicts(spark, sf_dir)
    decisions = _read(spark, sf_dir, "pages").filter("page_id % 2 = 0").select(F.col("page_id").alias("item_id"), F.lit("subject").alias("element"), F.lit("pass").alias("status"), F.lit("r1").alias("reviewer"))
    return verdict.after_review(verdicts, decisions).select("item_id", "element", "status", "decided_by")


def registry_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.integrity(_read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels").select("doc_id"), "doc_id", ("documents", "labels"))


def nearest_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest among the first vector of each label."""
    vectors = _read(spark, sf_dir, "embeddings")
    assets = vectors.groupBy(F.col("label").alias("asset")).agg(F.min_by("embedding", "vec_id").alias("descriptor"))
    return nearest.nearest_layout(vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("descriptor")), assets)


def script_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(folding.fold_letters(F.col("text"))).alias("folded_md5"))


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _issues_sql(name: str, key: str, text: str, shown: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {shown} CAST({i} AS INTEGER) AS ord, '{rule}' AS rule_id FROM {name} WHERE regexp_matches({text}, {_quoted([pattern])})" for i, (rule, pattern, _) in enumerate(TABLE_RULES)
    )


_ISSUES = _issues_sql("documents", "doc_id", "text", "doc_id,")
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1)"
_SUFFIX = f"lower(regexp_extract({_PATH}, '(?s)^.*[^/](\\.[^./]+)$', 1))"
_REGISTRY = f"SELECT {_HOST} AS host, min(page_id) AS column_key FROM pages WHERE starts_with(url, 'https://') GROUP BY 1"
_FIVE = f"""
WITH reg AS ({_REGISTRY}), p AS (
  SELECT page_id AS item_id, html, column_key, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading
  FROM (SELECT *, {_HOST} AS host FROM pages) AS q LEFT JOIN reg USING (host)
), e AS (
  SELECT item_id, 'subject' AS element, html, column_key, contains(html, '<title>') AS found, title AS value, heading FROM p
  UNION ALL SELECT item_id, 'time', html, column_key, contains(html, '<div class="ad">'), NULL, heading FROM p
  UNION ALL SELECT item_id, 'result', html, column_key, contains(html, '<article>'), NULL, heading FROM p
), v AS (
  SELECT item_id, element, value,
    CASE WHEN html IS NULL OR column_key IS NULL THEN 'engine_error' WHEN NOT found THEN 'missing'
         WHEN element <> 'time' AND NOT contains(html, '</html>') THEN 'unreadable'
         WHEN element = 'subject' AND value IS DISTINCT FROM heading THEN 'mismatch' ELSE 'pass' END AS status,
    CASE WHEN html IS NULL THEN 'decompose' WHEN column_key IS NULL THEN 'map' WHEN NOT found THEN 'extract'
         WHEN element <> 'time' AND NOT contains(html, '</html>') THEN 'extract' ELSE 'judge' END AS layer
  FROM e
)
"""
_REVIEW = f"status IN ({_quoted(fixed.REVIEW_STATES)})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            scan_issues, scan_issues_all, scan_verdict, scan_report, suffix_class, component_exclusion, distinct_sorted_names, literal_ci_search, registry_lookup, five_state, review_queue, decided, after_review, attribution,
            registry_integrity, nearest_layout, script_fold,
        )
    }


def oracle_sql() -> dict[str, str]:
    everything = " UNION ALL ".join(_issues_sql(name, key, text, f"'{name}' AS source_table, {key} AS item_id,") for name, key, text in TEXT_TABLES)
    flat = "SELECT item_id, element, status, layer, value FROM v"
    return {
        "scan_issues": _ISSUES,
        "scan_issues_all": everything,
        "scan_verdict": f"SELECT CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS n_issues FROM ({_ISSUES}) AS i",
        "scan_report": f"SELECT count(*) AS n_issues, coalesce(string_agg('sensitive text: ' || doc_id || ' / ' || rule_id, chr(10) ORDER BY doc_id, ord), '') AS report FROM ({_ISSUES}) AS i",
        "suffix_class": f"""SELECT page_id, {_SUFFIX} AS suffix, CASE WHEN {_SUFFIX} IN ({_quoted(fixed.HIGH_RISK_SUFFIXES)}) THEN 'high-risk' WHEN {_SUFFIX} = '.xlsx' THEN 'sheet'
            WHEN {_SUFFIX} IN ({_quoted(fixed.TEXT_SUFFIXES)}) OR regexp_extract({_PATH}, '[^/]*$', 0) = '.gitignore' THEN 'text' ELSE 'other' END AS class FROM pages""",
        "component_exclusion": f"SELECT page_id, {_PATH} AS rel FROM pages WHERE NOT list_has_any(string_split({_PATH}, '/'), ['fr', 'de'])",
        "distinct_sorted_names": f"SELECT DISTINCT source AS name FROM documents WHERE length(source) >= {fixed.LEAST_NAME} ORDER BY 1",
        "literal_ci_search": f"SELECT doc_id, lang FROM documents WHERE contains(lower(text), lower('{SEARCHED}'))",
        "registry_lookup": f"WITH reg AS ({_REGISTRY}) SELECT page_id, host, column_key, CASE WHEN column_key IS NULL THEN 'review' ELSE 'reuse' END AS route FROM (SELECT page_id, {_HOST} AS host FROM pages) AS p LEFT JOIN reg USING (host)",
        "five_state": f"{_FIVE} {flat}",
        "review_queue": f"{_FIVE} {flat} WHERE {_REVIEW}",
        "decided": f"{_FIVE} {flat} WHERE NOT {_REVIEW}",
        "after_review": f"""{_FIVE} SELECT item_id, element, CASE WHEN {_REVIEW} AND element = 'subject' AND item_id % 2 = 0 THEN 'pass' ELSE status END AS status,
            CASE WHEN NOT {_REVIEW} THEN 'rules' WHEN element = 'subject' AND item_id % 2 = 0 THEN 'r1' ELSE 'nobody' END AS decided_by FROM v""",
        "attribution": f"{_FIVE} SELECT layer, status, count(*) AS n FROM v GROUP BY layer, status",
        "registry_integrity": """SELECT count(d.doc_id) AS n_documents, count(l.doc_id) AS n_labels, count(CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 1 END) AS matched,
            count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS only_documents, count(CASE WHEN d.doc_id IS NULL THEN 1 END) AS only_labels FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
        "nearest_layout": """WITH a AS (SELECT label AS asset, arg_min(embedding, vec_id) AS descriptor FROM embeddings GROUP BY label), s AS (
              SELECT vec_id AS item_id, asset, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(descriptor AS DOUBLE[])), 6) AS score FROM embeddings CROSS JOIN a
            ), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, asset) AS n FROM s) SELECT item_id, asset, score FROM r WHERE n = 1""",
        "script_fold": f"SELECT doc_id, md5(translate(text, '{folding.ACCENTS[0]}', '{folding.ACCENTS[1]}')) AS folded_md5 FROM documents",
    }
