import itertools
import multiprocessing

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed, folding
from tidemark.operators import nearest, readers, verdict
from tidemark.sources import registry, shared

EVIDENCE = "item_id long, element string, executed boolean, column_resolved boolean, region_found boolean, readable boolean, value string"


def expected(element, executed, resolved, found, readable, value, subject):
    if not executed:
        return "engine_error", "decompose"
    if not resolved:
        return "engine_error", "map"
    if not found:
        return "missing", "extract"
    if element != "time" and not readable:
        return "unreadable", "extract"
    if element == "subject" and value != subject:
        return "mismatch", "judge"
    return "pass", "judge"


@pytest.fixture(scope="module")
def judged(spark):
    flags = (True, False, None)
    rows, want = [], {}
    for i, (element, ex, res, found, readable, value) in enumerate(itertools.product(fixed.ELEMENTS, flags, flags, flags, flags, ("acme", "other", None))):
        rows.append((i, element, ex, res, found, readable, value))
        want[i] = expected(element, ex, res, found, readable, value, "acme")
    evidence = spark.createDataFrame(rows, EVIDENCE)
    targets = spark.createDataFrame([(i, "acme") for i in range(len(rows))], "item_id long, subject string")
    return verdict.check_domain(verdict.judge(evidence, targets)).cache(), want


def test_truth_table(judged):
    df, want = judged
    assert {r["item_id"]: (r["status"], r["evidence"]["layer"]) for r in df.collect()} == want


def test_router_is_disjoint_and_complete(judged):
    df, want = judged
    review, done = verdict.review_queue(df), verdict.decided(df)
    assert review.count() + done.count() == len(want)
    assert {r["status"] for r in review.select("status").distinct().collect()} == {"unreadable", "engine_error"}


def test_review_changes_only_what_was_in_review(spark, judged):
    df, _ = judged
    decisions = spark.createDataFrame([(r["item_id"], r["element"], "pass", "r1") for r in df.collect()], "item_id long, element string, status string, reviewer string")
    after = {r["item_id"]: r for r in verdict.after_review(df, decisions).collect()}
    for r in df.collect():
        got = after[r["item_id"]]
        assert (got["status"], got["decided_by"]) == (("pass", "r1") if r["status"] in fixed.REVIEW_STATES else (r["status"], "rules"))


def test_domain_check_fails_on_other_states(spark):
    df = spark.createDataFrame([(1, "subject", "fine", ("judge", "s", "v"))], "item_id long, element string, status string, evidence struct<layer:string,source:string,value:string>")
    with pytest.raises(Exception, match="not a verdict: fine"):
        verdict.check_domain(df).collect()


def test_several_observations_take_the_gravest(spark):
    schema = "item_id long, element string, status string, evidence struct<layer:string,source:string,value:string>"
    rows = [(1, "subject", s, ("judge", "s", s)) for s in ("pass", "mismatch", "missing")] + [(2, "time", "missing", ("extract", "s", None)), (2, "time", "engine_error", ("map", "s", None))]
    got = {r["item_id"]: (r["status"], r["evidence"]["layer"]) for r in verdict.combined(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("mismatch", "judge"), 2: ("engine_error", "map")}


def test_blind_frames_cannot_hold_what_is_expected(spark):
    df = spark.createDataFrame([(1, "acme", b"x")], "item_id long, subject string, content binary")
    assert verdict.blind(df, ["item_id", "content"]).columns == ["item_id", "content"]
    with pytest.raises(ValueError, match="subject"):
        verdict.blind(df, ["item_id", "subject"])
    with pytest.raises(ValueError, match="subject"):
        readers.read_elements(df.withColumn("column_key", F.lit("k")), None, fixed.ELEMENTS)


def test_resolution_reuses_or_escalates(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "item_id long, host string")
    known = spark.createDataFrame([("a", "k2"), ("a", "k1"), (None, "k3")], "host string, column_key string")
    got = {r["item_id"]: (r["column_key"], r["route"]) for r in verdict.resolve(items, known, "host", "column_key").collect()}
    assert got == {1: ("k1", "reuse"), 2: (None, "review"), 3: (None, "review")}


def test_wide_has_no_overall_verdict(judged):
    df, _ = judged
    assert verdict.wide(df).columns == ["item_id", *fixed.ELEMENTS]


def test_integrity_counts(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert registry.integrity(a, b, "k").first().asDict() == {"n_left": 3, "n_right": 2, "matched": 1, "only_left": 1, "only_right": 1}
    empty = a.limit(0)
    assert tuple(registry.integrity(empty, empty, "k").first()) == (0, 0, 0, 0, 0)


def test_registry_must_be_well_formed(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text('[{"site": "a", "column_key": "k"}]')
    bad.write_text('[{"site": "a", "column_key": ')
    assert registry.read_registry(spark, str(good), "site string, column_key string").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        registry.read_registry(spark, str(bad), "site string, column_key string").collect()


def test_nearest_layout(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])], "item_id long, descriptor array<double>")
    assets = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "asset string, descriptor array<double>")
    got = {r["item_id"]: (r["asset"], r["score"]) for r in nearest.nearest_layout(items, assets).collect()}
    assert got == {1: ("a", 1.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("a", 0.707107)}


def test_many_assets_are_compared_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(1)
    vector = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(4)]
    items = spark.createDataFrame([(i, vector()) for i in range(40)], "item_id long, descriptor array<double>")
    assets = spark.createDataFrame([(f"a{i:03}", vector()) for i in range(150)], "asset string, descriptor array<double>")
    want = sorted(map(tuple, nearest.nearest_layout(items, assets).collect()))
    monkeypatch.setattr(nearest, "BLOCK_CELLS", 80)
    assert sorted(map(tuple, nearest.nearest_layout(items, assets).collect())) == want
    monkeypatch.setattr(nearest, "BROADCAST_CELLS", 2)
    assert sorted(map(tuple, nearest.nearest_layout(items, assets).collect())) == want


def test_chinese_table_is_one_to_one_and_folds_only_traditional_letters(spark):
    table = folding.CHINESE
    assert len(table[0]) == len(table[1]) == len(set(table[0])) and not set(table[0]) & set(table[1])
    df = spark.createDataFrame([("國會發體 国会发体 abc",)], "t string")
    assert df.select(folding.fold_letters(F.col("t"), table)).first()[0] == "国会发体 国会发体 abc"
    words = folding.fold_letters(folding.fold_words(F.col("t"), {"國會": "议会"}), table)
    assert df.select(words).first()[0] == "议会发体 国会发体 abc"


def test_folding(spark):
    df = spark.createDataFrame([("éñ 體體 体育",)], "t string")
    assert df.select(folding.fold_letters(F.col("t"))).first()[0] == "en 體體 体育"
    assert df.select(folding.fold_words(F.col("t"), {"體": "体", "體體": "X"})).first()[0] == "éñ X 体育"
    with pytest.raises(ValueError, match="same length"):
        folding.fold_letters(F.col("t"), ("ab", "c"))


def fake(content, column_key, element):
    if content == b"boom":
        raise RuntimeError
    if content == b"hang":
        import time

        time.sleep(60)
    return content != b"blank", content != b"blur", content.decode() if element == "subject" else None


def test_one_item_does_not_stop_others(spark):
    rows = [(1, b"acme", "k"), (2, b"boom", "k"), (3, b"hang", "k"), (4, b"blur", "k"), (5, b"blank", "k"), (6, b"acme", None)]
    items = spark.createDataFrame(rows, "item_id long, content binary, column_key string")
    evidence = readers.read_elements(items, fake, ("subject", "time"), seconds=2, retries=0)
    targets = spark.createDataFrame([(i, "acme") for i in range(1, 7)], "item_id long, subject string")
    got = {(r["item_id"], r["element"]): r["status"] for r in verdict.judge(evidence, targets).collect()}
    assert [got[i, "subject"] for i in range(1, 7)] == ["pass", "engine_error", "engine_error", "unreadable", "missing", "engine_error"]
    assert [got[i, "time"] for i in range(1, 7)] == ["pass", "engine_error", "engine_error", "pass", "missing", "engine_error"]
    assert evidence.filter("error = 'timeout'").count() == 2


def dying(content, column_key, element):
    import os

    if element == "time":
        os._exit(1)
    return True, True, "acme"


def test_a_killed_process_costs_one_element(spark):
    items = spark.createDataFrame([(1, b"x", "k")], "item_id long, content binary, column_key string")
    got = {r["element"]: (r["executed"], r["error"]) for r in readers.read_elements(items, dying, fixed.ELEMENTS, seconds=20).collect()}
    assert got == {"subject": (True, None), "time": (False, "died"), "result": (True, None)}
    plain = readers.isolated(fake, [(b"boom", "k", "subject"), (b"acme", "k", "subject")], None)
    assert plain == [(None, "RuntimeError"), ((True, True, "acme"), None)]


def by_process(content, column_key, element):
    """The process's number as value; a failure spoils its process for all that come after."""
    import os

    if content == b"die":
        os._exit(1)
    if content == b"boom":
        os.environ["SPOILED"] = "1"
        raise ValueError
    if "SPOILED" in os.environ:
        raise KeyError
    return True, True, str(os.getpid())


def readings(spark, contents, **more):
    items = spark.createDataFrame([(i, c, "k") for i, c in enumerate(contents)], "item_id long, content binary, column_key string").coalesce(1)
    return readers.read_elements(items, by_process, ("subject",), **more).collect()


def test_items_that_go_well_share_a_process(spark):
    """Starting one takes most of the time of a reading."""
    got = readings(spark, [b"ok"] * 300)
    assert len(got) == 300 and all(r["executed"] for r in got)
    assert len({r["value"] for r in got}) <= 300 // readers.ITEMS + 5


@pytest.mark.parametrize("retries", [0, 1])
def test_a_failure_ends_its_process(spark, retries):
    contents = [b"die" if i % 10 == 3 else b"boom" if i % 10 == 7 else b"ok" for i in range(60)]
    got = {r["item_id"]: r["error"] for r in readings(spark, contents, retries=retries)}
    assert got == {i: {b"die": "died", b"boom": "ValueError", b"ok": None}[c] for i, c in enumerate(contents)}


def spoiling(content, column_key, element):
    """Answers, but spoils the process for the next item."""
    import os

    if content == b"after" and "SPOILED" in os.environ:
        raise KeyError
    os.environ["SPOILED"] = "1"
    return True, True, None


def test_what_fails_in_a_shared_process_is_read_alone(spark):
    items = spark.createDataFrame([(0, b"before", "k"), (1, b"after", "k")], "item_id long, content binary, column_key string").coalesce(1)
    assert [r["error"] for r in readers.read_elements(items, spoiling, ("subject",), retries=0).collect()] == [None, None]


def test_calls_after_a_time_out_or_a_death_get_answers():
    calls = lambda c: [(c, "k", "subject"), (b"blank", "k", "time")]
    found = readers.isolated_items(fake, [calls(b"acme"), [], calls(b"hang"), calls(b"boom"), calls(b"acme")], seconds=1)
    fine, blank = (((True, True, "acme"), None), ((False, True, None), None))
    assert found == [([fine, blank], False), ([], True), ([(None, "timeout"), blank], True), ([(None, "RuntimeError"), blank], False), ([fine, blank], False)]


def test_a_failing_item_costs_one_more_process(monkeypatch):
    started = []

    class Counted:
        def __init__(self, context):
            self.Pipe, self.of = context.Pipe, context.Process

        def Process(self, **more):
            started.append(more)
            return self.of(**more)

    fork = multiprocessing.get_context("fork")
    monkeypatch.setattr(readers.multiprocessing, "get_context", lambda kind: Counted(fork))
    found = readers.isolated_items(fake, [[(b"boom" if i % 10 == 3 else b"acme", "k", "subject")] for i in range(64)])
    assert [i for i, ((_, error),) in ((i, x) for i, (x, _) in enumerate(found)) if error] == list(range(3, 64, 10))
    assert len(started) == 7


def test_batches_of_contents_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    items = spark.createDataFrame([(1, b"x", "k")], "item_id long, content binary, column_key string")
    readers.read_elements(items, None, fixed.ELEMENTS)
    assert int(spark.conf.get(key)) <= shared.CONTENT_ROWS


def test_without_a_reader_all_goes_to_review(spark):
    items = spark.createDataFrame([(1, b"x", "k")], "item_id long, content binary, column_key string")
    targets = spark.createDataFrame([(1, "acme")], "item_id long, subject string")
    df = verdict.judge(readers.read_elements(items, None, fixed.ELEMENTS), targets)
    assert verdict.review_queue(df).count() == 3


def test_decompose_and_align(spark):
    def splitter(content):
        if content == b"bad":
            raise ValueError
        return [("viewport", "query", 10, 10, 5, 5), ("viewport", "query", 90, 90, 5, 5)]

    items = spark.createDataFrame([(1, b"ok"), (2, b"bad")], "item_id long, content binary")
    regions = readers.decompose(items, splitter)
    assert regions.filter("error is null").count() == 2 and regions.filter("error = 'ValueError'").count() == 1
    seen = regions.filter("error is null").withColumn("column_key", F.lit("k"))
    want = spark.createDataFrame([("k", "viewport", "query", 80, 80), ("k", "os", "clock", 0, 0)], "column_key string, space string, role string, x int, y int")
    assert [tuple(r) for r in readers.align(want, seen).collect()] == [(1, "k", "viewport", "query", 90, 90, 5, 5)]
