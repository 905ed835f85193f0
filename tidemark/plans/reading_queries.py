"""Manuscripts, readers and verdicts as queries, over items that are made from the pages.

A page's html is the item's content and stands for its image; by their numbers
some lack a region, some can't be read to the end and some make the reader fail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, folding
from ..operators import readers, verdict
from ..sources import manuscript, registry, tree
from ..sources.shared import new_path, tasks_of
from .table_queries import _FIVE, _HOST, _REGISTRY, _five_verdicts, _host, _page_registry

#: (element, what marks its region)
REGIONS = (("subject", "<title>"), ("time", '<div class="ad">'), ("result", "<article>"))
#: Marks of the regions that are found by place, all of one role.
MARKS = ("<h1>", "<article>")
#: Where the registry has that role.
MAP_X, MAP_Y = 1500, 0
# Valid in both dialects.
_CONTENT = "CASE WHEN page_id % 13 = 1 THEN replace(html, '<article>', '<section>') WHEN page_id % 7 = 2 THEN replace(html, '</html>', '') ELSE html END"
_BROKEN = "page_id % 10 = 3"
_TARGET = "CASE WHEN page_id % 17 = 5 THEN 'someone else' ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END"
#: Words before letters: a word's variant isn't always that of its letters.
WORDS = {"軟體": "软件", "網路": "网络"}
_CHINESE_TEXT = "text || CASE doc_id % 3 WHEN 0 THEN ' 國會體育' WHEN 1 THEN ' 軟體與網路' ELSE ' 国会体育' END"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def page_reader(content: bytes, column_key: str, element: str) -> tuple[bool, bool | None, str | None]:
    """A reader of html: the element's region by its mark, and of the subject the text; it fails on bytes that aren't UTF-8."""
    html = content.decode("utf-8")
    at = html.find(dict(REGIONS)[element])
    value = html[at + len("<title>") : html.find("</title>", at)] if element == "subject" and at >= 0 else None
    return at >= 0, "</html>" in html, value


def page_regions(content: bytes) -> list[tuple[str, str, int, int, int, int]]:
    """The places of MARKS, as (space, role, x, y, w, h)."""
    html = content.decode("utf-8")
    return [("viewport", "item", at, 0, len(mark), 1) for mark in MARKS if (at := html.find(mark)) >= 0]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind items: nothing of them tells what is expected."""
    content = F.concat(F.expr(f"CASE WHEN {_BROKEN} THEN X'FF' ELSE X'' END"), F.encode(F.expr(_CONTENT), "UTF-8")).alias("content")
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("item_id"), _host(F.col("url")).alias("host"), content, F.expr(_TARGET).alias("subject"))
    known = verdict.resolve(pages, _page_registry(spark, sf_dir), "host", "column_key")
    return verdict.blind(known.withColumn("column_key", F.col("column_key").cast("string")), ["item_id", "content", "column_key"])


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(F.col("page_id").alias("item_id"), F.expr(_TARGET).alias("subject"))


def _flat(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("item_id", "element", "status", F.col("evidence.layer").alias("layer"), F.col("evidence.source").alias("source"), F.col("evidence.value").alias("value"))


def read_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = readers.read_elements(_items(spark, sf_dir), page_reader, fixed.ELEMENTS, tasks=tasks_of(spark))
    return _flat(verdict.check_domain(verdict.judge(evidence, _targets(spark, sf_dir))))


def reader_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = readers.read_elements(_items(spark, sf_dir), page_reader, ("subject",), retries=1, tasks=tasks_of(spark))
    return evidence.filter("error is not null").select("item_id", "error")


def degraded_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a reader every element goes to review."""
    evidence = readers.read_elements(_items(spark, sf_dir), None, fixed.ELEMENTS)
    return _flat(verdict.review_queue(verdict.judge(evidence, _targets(spark, sf_dir))))


def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.decompose(_items(spark, sf_dir), page_regions)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    seen = readers.decompose(items, page_regions).filter("error is null").join(items.select("item_id", "column_key"), "item_id")
    expected = items.filter("column_key is not null").select("column_key").distinct()
    expected = expected.select("column_key", F.lit("viewport").alias("space"), F.lit("item").alias("role"), F.lit(MAP_X).alias("x"), F.lit(MAP_Y).alias("y"))
    return readers.align(expected, seen)


def wide_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.wide(_five_verdicts(spark, sf_dir))


def combined_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth item was looked at twice, the second time without a reader."""
    first = _five_verdicts(spark, sf_dir)
    again = readers.read_elements(_items(spark, sf_dir).filter("item_id % 4 = 0"), None, fixed.ELEMENTS)
    both = verdict.combined(first.unionByName(verdict.judge(again, _targets(spark, sf_dir))))
    return both.select("item_id", "element", "status", F.col("evidence.layer").alias("layer"))


def registry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry, written as JSON and read again with its schema, where a malformed entry fails."""
    path = new_path(spark, "registry")
    _page_registry(spark, sf_dir).write.json(path)
    return registry.read_registry(spark, path, "host string, column_key long", lines=True)


def _manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    lines = F.array(F.concat(F.lit("Subject: "), title, F.lit(" @ "), _host(F.col("url"))), F.lit(""), F.lit("Result: [[result]] [[todo]]"))
    rel = F.concat(F.lit("m"), F.col("page_id").cast("string"), F.lit(".docx")).alias("rel")
    return manuscript.compose(_pages(spark, sf_dir).select(rel, lines.alias("lines")), tasks_of(spark))


def manuscript_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript.manuscript_items(_manuscripts(spark, sf_dir))


def manuscript_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript.map_items(manuscript.manuscript_items(_manuscripts(spark, sf_dir)), r"^Subject: (.*) @ (\S+)$")


def manuscript_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled and cleaned copies at new paths, listed and read again."""
    root = new_path(spark, "exports").removeprefix("file://")
    fill = F.create_map(F.lit("[[result]]"), F.concat(F.lit("pass & <done> "), F.col("rel")))
    failed = manuscript.export_files(_manuscripts(spark, sf_dir).withColumn("fill", fill), root).filter("error is not null").count()
    if failed:
        raise RuntimeError(f"{failed} copies weren't written")
    copies = tree.read_contents(tree.list_tree(spark, root).select("rel"), root)
    return manuscript.manuscript_items(copies)


def script_fold_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, then letters, from traditional to simplified Chinese."""
    text = F.expr(_CHINESE_TEXT)
    folded = folding.fold_letters(folding.fold_words(text, WORDS), folding.CHINESE)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(folded).alias("folded_md5"), F.contains(folded, F.lit("国会体育")).alias("found"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            read_verdicts, reader_errors, degraded_mode, decomposed, aligned, wide_verdicts, combined_verdicts, registry_json,
            manuscript_items, manuscript_mapping, manuscript_export, script_fold_words,
        )
    }


_READ = f"""
WITH reg AS ({_REGISTRY}), p AS (
  SELECT page_id AS item_id, {_CONTENT} AS html, {_BROKEN} AS broken, column_key, {_TARGET} AS subject
  FROM (SELECT *, {_HOST} AS host FROM pages) AS q LEFT JOIN reg USING (host)
), e AS (
  SELECT *, 'subject' AS element, contains(html, '<title>') AS found, CASE WHEN NOT broken AND column_key IS NOT NULL THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS value FROM p
  UNION ALL SELECT *, 'time', contains(html, '<div class="ad">'), NULL FROM p
  UNION ALL SELECT *, 'result', contains(html, '<article>'), NULL FROM p
)
"""


def oracle_sql() -> dict[str, str]:
    regions = " UNION ALL ".join(f"SELECT item_id, column_key, instr(html, '{mark}') - 1 AS x, {len(mark)} AS w FROM p WHERE NOT broken AND contains(html, '{mark}')" for mark in MARKS)
    title, rel = "regexp_extract(html, '<title>([^<]*)</title>', 1)", "'m' || page_id || '.docx'"
    return {
        "read_verdicts": f"""{_READ} SELECT item_id, element,
              CASE WHEN column_key IS NULL OR broken THEN 'engine_error' WHEN NOT found THEN 'missing' WHEN element <> 'time' AND NOT contains(html, '</html>') THEN 'unreadable'
                   WHEN element = 'subject' AND value IS DISTINCT FROM subject THEN 'mismatch' ELSE 'pass' END AS status,
              CASE WHEN column_key IS NULL THEN 'map' WHEN broken THEN 'decompose' WHEN NOT found OR (element <> 'time' AND NOT contains(html, '</html>')) THEN 'extract' ELSE 'judge' END AS layer,
              'reader:' || element AS source, value FROM e""",
        "reader_errors": f"{_READ} SELECT item_id, 'UnicodeDecodeError' AS error FROM p WHERE broken AND column_key IS NOT NULL",
        "degraded_mode": f"{_READ} SELECT item_id, element, 'engine_error' AS status, 'decompose' AS layer, 'reader:' || element AS source, CAST(NULL AS VARCHAR) AS value FROM e",
        "decomposed": f"""{_READ} SELECT item_id, 'viewport' AS space, 'item' AS role, CAST(x AS INTEGER) AS x, CAST(0 AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(1 AS INTEGER) AS h, CAST(NULL AS VARCHAR) AS error FROM ({regions}) AS r
              UNION ALL SELECT item_id, NULL, NULL, NULL, NULL, NULL, NULL, 'UnicodeDecodeError' FROM p WHERE broken""",
        "aligned": f"""{_READ}, r AS ({regions}), n AS (
              SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (x - {MAP_X}) * (x - {MAP_X}), x) AS k FROM r WHERE column_key IS NOT NULL
            ) SELECT item_id, CAST(column_key AS VARCHAR) AS column_key, 'viewport' AS space, 'item' AS role, CAST(x AS INTEGER) AS x, CAST(0 AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(1 AS INTEGER) AS h FROM n WHERE k = 1""",
        "wide_verdicts": f"{_FIVE} SELECT item_id, " + ", ".join(f"max(CASE WHEN element = '{e}' THEN status END) AS {e}" for e in fixed.ELEMENTS) + " FROM v GROUP BY item_id",
        "combined_verdicts": f"""{_FIVE} SELECT item_id, element, CASE WHEN item_id % 4 = 0 THEN 'engine_error' ELSE status END AS status,
              CASE WHEN item_id % 4 = 0 THEN CASE WHEN status = 'engine_error' THEN greatest(layer, 'decompose') ELSE 'decompose' END ELSE layer END AS layer FROM v""",
        "registry_json": f"{_REGISTRY}",
        "manuscript_items": f"""SELECT {rel} AS rel, CAST(0 AS BIGINT) AS item_id, 'Subject: ' || {title} || ' @ ' || {_HOST} AS text, CAST(NULL AS VARCHAR) AS error FROM pages
              UNION ALL SELECT {rel}, 1, 'Result: [[result]] [[todo]]', NULL FROM pages""",
        "manuscript_mapping": f"SELECT {rel} AS rel, CAST(0 AS BIGINT) AS item_id, trim({title}) AS expected_subject, {_HOST} AS column_key FROM pages",
        "manuscript_export": f"""SELECT {rel} AS rel, CAST(0 AS BIGINT) AS item_id, 'Subject: ' || {title} || ' @ ' || {_HOST} AS text, CAST(NULL AS VARCHAR) AS error FROM pages
              UNION ALL SELECT {rel}, 1, 'Result: pass & <done> ' || {rel} || ' ', NULL FROM pages""",
        "script_fold_words": f"""SELECT doc_id, md5(folded) AS folded_md5, contains(folded, '国会体育') AS found FROM (
              SELECT doc_id, translate(replace(replace({_CHINESE_TEXT}, '軟體', '软件'), '網路', '网络'), '{folding.CHINESE[0]}', '{folding.CHINESE[1]}') AS folded FROM documents) AS d""",
    }
