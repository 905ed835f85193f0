import collections

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_llm_rows import check_packing
from tidemark.llm import quality_rules
from tidemark.llm.common import materialize


def test_stages_one_by_one(spark, documents, corpus):
    """Each stage's result, from the rows it was given."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mixing", "packing"]
    docs, given = documents, dict(corpus)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, ""), "test")
        assert out.columns == documents.columns and [f.dataType for f in out.schema] == [f.dataType for f in documents.schema]
        rows = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name == "quality_rules":
            want = {i: t for i, t in given.items() if brute.quality(t, quality_rules.NGRAM_LIMITS, quality_rules.LINE_LIMIT)[6]}
        elif name == "line_dedup":
            found = brute.line_dedup(list(given.items()))
            want = {i: x[0] for i, x in found.items() if not (x[2] and not brute.words(x[0]))}
        elif name == "minhash_near_dedup":
            want = {i: given[i] for i, x in brute.near_components(list(given.items())).items() if x[2]}
        else:
            total = sum(len(brute.words(t)) for t in given.values())
            assert abs(sum(len(brute.words(t)) for _, t in rows) - total) <= 10
            assert all(n <= 3 for n in collections.Counter(i for i, _ in rows).values())
            assert all(given[i].startswith(t) for i, t in rows)
            break
        assert dict(rows) == want and len(rows) == len(want)
        docs, given = out, want
    # Packed here from the rows before mixing, where ids are still unique.
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, ""), given, 2048)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and "sequence_id" in out.columns
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_near_copies_without_ids(spark):
    text = lambda k: " ".join(f"w{i}" for i in range(k, k + 60))
    rows = [(5, text(0), "a"), (None, text(0), "b"), (None, text(1), "c"), (None, text(500), "d"), (None, text(500), "e"), (None, text(501), "f"), (None, None, "g"), (7, "", "h")]
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    docs = spark.createDataFrame(rows, "doc_id int, text string, more string")
    out = stage(spark, docs, "")
    assert out.schema == docs.schema
    got = sorted(map(tuple, out.collect()), key=str)
    assert [r[0] for r in got if r[2] in "abc"] == [5] and sum(r[2] in "def" for r in got) == 1 and {r[2] for r in got} >= {"g", "h"}
    assert {r[0] for r in got if r[2] in "defg"} == {None}


def test_stages_with_further_columns_and_repeated_rows(spark, clashing):
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(80))
    twice = clashing.filter("doc_id <= 30")
    rows = twice.unionByName(twice.filter("doc_id <= 3")).unionByName(twice.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(long)))
    for more in ("n_lines", "n_removed", "kept_id", "c0", "covered"):
        rows = rows.withColumn(more, F.lit(5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, "")
        assert out.columns == rows.columns and {r["n_removed"] for r in out.select("n_removed").collect()} <= {5}
        if name == "minhash_near_dedup":
            assert out.count() == out.dropDuplicates(["doc_id", "text"]).count() >= 25
            assert out.filter("doc_id is null").count() == 1
        assert stage(spark, rows.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, "").filter("doc_id is null").count() == 1
