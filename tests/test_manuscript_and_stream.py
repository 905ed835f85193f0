import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.rules import Rule
from tidemark.sources import manuscript, tree
from tidemark.streaming import scan_stream

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*lines):
    body = "".join(f"<w:p><w:commentRangeStart w:id=\"0\"/><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/comments.xml", "<c/>")
        z.writestr("[Content_Types].xml", '<Types><Override PartName="/word/comments.xml" ContentType="c"/></Types>')
    return out.getvalue()


def test_items_and_mapping(spark):
    files = spark.createDataFrame([("a.docx", docx("Subject: Acme @ site1", "", "x")), ("b.docx", b"not a zip")], "rel string, content binary")
    items = manuscript.manuscript_items(files)
    assert sorted((r["rel"], r["item_id"], r["text"], r["error"]) for r in items.filter("error is null").collect()) == [("a.docx", 0, "Subject: Acme @ site1", None), ("a.docx", 1, "x", None)]
    assert [r["error"] for r in items.filter("rel = 'b.docx'").collect()] == ["BadZipFile"]
    assert [tuple(r) for r in manuscript.map_items(items, r"^Subject: (.*) @ (\S+)$").collect()] == [("a.docx", 0, "Acme", "site1")]


class Captured:
    """Stands for a DataFrame, to run what an operator gives its tasks."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *names):
        return self

    def mapInPandas(self, f, schema):
        return f


def test_many_manuscripts_share_a_frame(spark):
    """A frame for each of them took ten times as long as reading them."""
    run = manuscript.manuscript_items(Captured(spark))
    files = pd.DataFrame({"rel": [f"m{i}" for i in range(3000)], "content": [docx("a", "b")] * 2999 + [b"not a zip"]})
    frames = list(run([files, files.iloc[:0]]))
    assert 5 <= len(frames) <= 7
    got = pd.concat(frames)
    assert len(got) == 2 * 2999 + 1 and got["rel"].nunique() == 3000 and list(got["text"][:2]) == ["a", "b"]
    assert [(r, e) for r, e in zip(got["rel"], got["error"], strict=True) if e] == [("m2999", "BadZipFile")]


def test_batches_of_manuscripts_are_bounded(spark):
    """A batch of 10,000 contents grew with the input, in both processes of each task."""
    files = spark.range(6000, numPartitions=1).select(F.col("id").cast("string").alias("rel"), F.array(F.lit("a")).alias("lines"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    made = manuscript.compose(files)

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    assert made.mapInPandas(sizes, "n long").agg(F.max("n"), F.sum("n")).first()[:] == (256, 6000)


def test_files_of_one_directory_are_read_by_many_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"m{i}.docx").write_bytes(b"%d" % i)
    read = tree.read_contents(tree.list_tree(spark, str(tmp_path)), str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {r["rel"]: r["content"] for r in read} == {f"m{i}.docx": b"%d" % i for i in range(200)}
    assert len({r["task"] for r in read}) >= spark.sparkContext.defaultParallelism


def test_export_is_a_clean_copy(tmp_path):
    source = docx("Result: [[r1]] [[todo]]")
    path = str(tmp_path / "out" / "copy.docx")
    manuscript.export_copy(source, path, {"[[r1]]": "pass & done"})
    with zipfile.ZipFile(path) as z:
        assert "word/comments.xml" not in z.namelist()
        assert b"comment" not in z.read("word/document.xml") and b"comments" not in z.read("[Content_Types].xml")
    assert manuscript.paragraphs(open(path, "rb").read()) == ["Result: pass & done "]
    assert manuscript.paragraphs(source) == ["Result: [[r1]] [[todo]]"]
    with pytest.raises(FileExistsError):
        manuscript.export_copy(source, path, {})


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", "has KEYX"), (2, "2024-01-01 00:00:50", "none"), (3, "2024-01-01 00:03:00", "KEYX KEYX")]
    spark.createDataFrame(rows, "id int, ts string, text string").selectExpr("id", "cast(ts as timestamp) ts", "text").write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("id int, ts timestamp, text string").parquet(str(tmp_path / "in"))
    issues = scan_stream.issues_stream(texts, "text", [Rule(0, "key", "KEYX", "KEYX")], ["id", "ts"])
    for _ in range(2):  # a restart writes nothing twice
        scan_stream.write_issues(issues, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]
    q = scan_stream.issue_counts(issues, "ts", "1 minute", "1 minute").writeStream.format("memory").queryName("issue_counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["rule_id"], r["n"]) for r in spark.table("issue_counts").collect()][:1] == [("key", 1)]
