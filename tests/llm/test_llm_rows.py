import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import mixing, packing, topk, url_filter
from tidemark.llm.components import components
from tidemark.llm.quality_classifier import features, quality_scores
from tidemark.llm.queries import held_out, oracle_sql, queries, tokenizer


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_gives_the_rows_of_its_sql(same_as_sql, name):
    same_as_sql(queries()[name], oracle_sql()[name])


def first_fit_by_hand(counts, window):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            best = min((r for r in rooms if r >= length), default=None)
            if best is None:
                rooms.append(window - length)
            else:
                rooms.remove(best)
                rooms.append(best - length)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda w: st.tuples(st.just(w), st.dictionaries(st.integers(1, w), st.integers(1, 25), max_size=20))))
def test_plan_is_that_of_best_fit_decreasing(case):
    window, counts = case
    held, placed = collections.defaultdict(list), collections.Counter()
    for length, first, run, per, start, offset in packing.best_fit_decreasing(counts, window):
        assert first == placed[length]
        placed[length] += run
        for j in range(run):
            held[start + j // per].append((offset + j % per * length, length))
    assert placed == counts
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(window - sum(n for _, n in p) for p in held.values()) == first_fit_by_hand(counts, window)


def check_packing(out, texts, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out.collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= window
    return [sum(n for _, n in s) for s in sequences.values()]


def test_packing(clashing, corpus):
    totals = check_packing(packing.pack(clashing, tokenizer(), 256), dict(corpus), 256)
    assert sum(256 - n for n in totals) < 256 + 0.01 * sum(totals)


def test_packing_of_odd_texts(spark):
    texts = {1: "a<|endoftext|>b  <|endoftext|> x", 2: "  \n\n\t x", 3: "don't I'LL é中文😀  x", 4: "x" * 20_000, 5: " " * 9_000, 6: "\x00\x1c  a", 7: "１２３ ١٢ 12a", 8: None, 9: ""}
    check_packing(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer()), texts, 2048)


def test_both_encoders_give_the_same_ids(monkeypatch):
    texts = ["It's été 中文 <|endoftext|> 12", "", "x" * 3000, " \n\t "]
    assert packing.ranks_agree(tokenizer())
    for t in texts:
        assert packing.encoder(tokenizer())(t).tolist() == packing.encoder(tokenizer(), by_ranks=False)(t).tolist()
    monkeypatch.setattr(packing, "ranked", lambda path: None)  # as if tiktoken could not take a text
    assert [packing.encoder(tokenizer())(t).tolist() for t in texts] == [packing.encoder(tokenizer(), by_ranks=False)(t).tolist() for t in texts]


def test_only_plain_files_are_encoded_by_ranks(tmp_path):
    import json

    with open(tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    packing.check_plain(spec)
    for change in (
        {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
        {"model": spec["model"] | {"ignore_merges": True}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}},
    ):
        with pytest.raises(ValueError, match="not by ranks"):
            packing.check_plain(spec | change)
    other = tmp_path / "t.json"
    other.write_text(json.dumps(spec | {"normalizer": {"type": "Lowercase"}}))
    assert not packing.ranks_agree(str(other))
    assert packing.encoder(str(other), packing.ranks_agree(str(other)))("ABC abc").tolist() == packing.whole_tokenizer(str(other)).encode("ABC abc", add_special_tokens=False).ids


def test_packing_of_repeated_rows(spark):
    out = packing.pack(spark.createDataFrame([(1, "a b")] * 3 + [(None, "c")], "doc_id long, text string"), tokenizer()).collect()
    assert len(out) == 4 and len({(r["sequence_id"], r["offset"]) for r in out}) == 4
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer()).count() == 0


def by_hand(sizes, weights=(1, 2, 3)):
    """Targets by raising the level source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


@pytest.fixture(scope="module")
def mixed(clashing):
    sized = clashing.drop("size").withColumn("size", mixing.words_in(F.col("text")))
    return sized.select("doc_id", "source"), mixing.mix(sized, shards=5).cache()


def test_mixing(mixed, corpus):
    sources, out = mixed
    size = {i: len(brute.words(t)) for i, t in corpus}
    source = dict(sources.collect())
    sums, taken = collections.Counter(), collections.Counter()
    for i, s in source.items():
        sums[s] += size[i]
    want = by_hand(sums)
    for r in out.collect():
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == sums[source[i]] and r["target"] == pytest.approx(want[source[i]], abs=1e-5)
        assert 0 <= r["taken"] <= 3 * size[i] and r["taken"] == r["rounds"] * size[i] + r["last_words"]
        assert len(r["shards"]) == (r["rounds"] + (r["last_words"] > 0) if size[i] else 0) and all(0 <= s < 5 for s in r["shards"])
        taken[source[i]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 for s in sums)
    assert out.count() == len(corpus)


def test_mixing_reruns_agree(mixed, clashing):
    sized = clashing.repartition(3).drop("size").withColumn("size", mixing.words_in(F.col("text")))
    assert sorted(map(str, mixing.mix(sized, shards=5).collect())) == sorted(map(str, mixed[1].collect()))


def test_mixing_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 10)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randint(0, 50)) for i in range(600)] + [(700 + i, "z", 1) for i in range(3)] + [(800, "y", 0), (900, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").fillna(0, "size")
    out = mixing.mix(df, shards=4)
    sums = collections.Counter()
    for _, s, n in rows:
        sums[s] += n or 0
    want = by_hand(sums)
    got = {r["source"]: r["k"] for r in out.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("k")).collect()}
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 2 for s in want)
    assert got["z"] == 9


def test_units_split_exactly_and_without_loss(spark):
    units = spark.createDataFrame([(s, b, 1) for s in range(3) for b in range(20 + s)], "source_no long, block int, round long")
    for shards in (1, 3, 8):
        out = mixing.split_units(units, shards).collect()
        assert collections.Counter(tuple(r)[:3] for r in out) == collections.Counter(tuple(r) for r in units.collect())
        sizes = collections.Counter(r["shard"] for r in out).values()
        assert len(sizes) == shards and max(sizes) - min(sizes) <= 2


def test_mixed_documents_are_what_was_planned(clashing, mixed, corpus):
    out = mixing.mixed_documents(clashing, shards=5)
    assert out.columns == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
    words, text = collections.Counter(), dict(corpus)
    for r in out.collect():
        words[r["doc_id"]] += len(brute.words(r["text"]))
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert words == collections.Counter({r["doc_id"]: r["taken"] for r in mixed[1].collect()}) or +words == +collections.Counter({r["doc_id"]: r["taken"] for r in mixed[1].collect()})


def test_mixing_of_nothing(spark, documents):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    assert mixing.mixed_documents(documents.limit(0)).count() == 0
    zero = mixing.mix(spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, size long")).first()
    assert (zero["target"], zero["taken"], zero["shards"]) == (0.0, 0, [])


def test_mixing_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", 5), (1, "a", 5), (None, "a", 7), (None, "a", 7), (None, None, 4), (2, None, 0), (3, "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and len({str(r) for r in got}) == 5  # repeated rows are taken alike
    taken, want = collections.Counter(), by_hand({"a": 24, "b": 9, None: 4})
    for r in got:
        taken[r["source_size"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[n] - want[s]) <= 2 for s, n in (("a", 24), ("b", 9), (None, 4)))


URLS = {
    1: "http://a.example.net/en/1?x#y", 2: "https://EXAMPLE.net/de/1", 3: "https://example.net", 4: None, 5: "no scheme/", 6: "ftp://notexample.net/en/", 7: "http://x.example.com/de/a", 8: "http://example.com/den",
    9: "http://deep.sub.org/fr/x", 10: "http://org/fr/", 11: "http://://net/", 12: "http://a.net?q=/en/", 13: "http://a.net/?q", 14: "http://example.net:80/en/", 15: "http:///en/", 16: "", 17: "://net/x", 18: "http://net./x",
}


def judged_by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]
    host = host.translate(brute.LOWER)
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


def test_url_rules(spark):
    more = (*url_filter.RULES, ("sub.org", "/", "block"), ("deep.sub.org", "/fr/x/", "block"), ("example.net", "/", "block"), ("example.net", "/en/1", "block"))
    df = spark.createDataFrame(list(URLS.items()), "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("x"))
    for rules in (url_filter.RULES, more):
        out = url_filter.judge_urls(df, spark.createDataFrame(list(rules), "host string, path string, verdict string"))
        assert {r["page_id"]: tuple(r)[1:] for r in out.collect()} == {i: judged_by_hand(u, rules) for i, u in URLS.items()}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.judge_urls(df, none).collect()} == {"allow"}
    assert url_filter.judge_urls(df.limit(0), none).count() == 0


def test_url_rules_of_a_hot_host_repeated_rows_and_null_ids(spark):
    rows = [(i if i % 3 else None, f"http://a{'.b' * (i % 2)}.example.net/{'en' if i % 5 else 'de'}/{i % 7}") for i in range(400)] * 2
    rows += [(9, f"http://{'x.' * 5000}org/fr/")]
    more = [*url_filter.RULES, *((f"h{i}.org", "/", "block") for i in range(300))]
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(more, "host string, path string, verdict string"))
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect())
    assert got == collections.Counter((i, *judged_by_hand(u, more)) for i, u in rows)


def top_by_hand(vectors, every, k):
    q = {i: np.floor(64 * np.array(v, dtype=float)) for i, v in vectors.items()}
    out = []
    for i in q:
        if i % every == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("dims", [1, 3, 16])
def test_top_k(spark, dims, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(dims)
    vectors = {int(i): np.round(rng.normal(size=dims), 1).tolist() for i in range(200)}  # many ties
    vectors |= {300 + i: vectors[20] for i in range(60)}
    rows = [*vectors.items(), (40, vectors[40]), (998, None), (999, [None] * dims), (997, [float("nan")] * dims), (960, [float("inf")] * dims), (None, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(1))
    exact = {i: np.array(v, dtype=np.float32).astype(float) for i, v in vectors.items()}
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == top_by_hand(exact, 20, 20)


def test_top_k_of_few_and_of_huge_numbers(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 2.0]), (20, [2.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df).collect()}
    assert got[20, 1] == 128 * 64 and got[0, 1] == 2**63 - 1 and len(got) == 4
    assert topk.top_k(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(500), rng.randrange(500)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3), (3000, 3000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classifier_on_held_out_rows(spark):
    df = queries()["op6_quality_classifier"](spark, "/root/testdata/sf0.01")
    rows = df.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert df.count() == 1000


def test_classifier_learns_nothing_from_what_it_may_not(spark, clashing):
    labels = [(r["doc_id"], (r["doc_id"] % 3 > 0) * 1) for r in clashing.select("doc_id").collect()]
    table = lambda flip: spark.createDataFrame([(i, q ^ flip(i)) for i, q in labels] + [(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    outside = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a, b = ({r["doc_id"]: r["score"] for r in quality_scores(clashing, table(f), lambda d: ~held_out(d)).collect()} for f in (lambda i: 0, outside))
    assert a == b and len(a) == len(labels)
    one_kind = quality_scores(clashing, table(lambda i: 0).filter("quality = 1"), lambda d: ~held_out(d))
    assert one_kind.count() == len(labels)
    assert quality_scores(clashing.limit(0), table(lambda i: 0), lambda d: ~held_out(d)).count() == 0


def test_repeated_documents_change_no_score(spark, documents):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(1, 181)], "doc_id long, quality int")
    scores = lambda df: {(r["doc_id"], r["score"]) for r in quality_scores(df, labels, lambda d: F.lit(True), max_fit=120).collect()}
    once = scores(documents)
    assert len({s for _, s in once}) > 100
    thrice = documents.unionByName(documents).unionByName(documents)
    assert scores(thrice) == once and quality_scores(thrice, labels, lambda d: F.lit(True), max_fit=120).count() == 3 * documents.count()


def test_scores_are_those_of_plain_gradient_descent(spark, corpus, documents):
    from tidemark.llm import quality_classifier as q

    labels = {i: int(i % 3 > 0) for i, _ in corpus}
    df = quality_scores(documents, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), lambda d: F.lit(True))
    got = {r["doc_id"]: r["score"] for r in df.collect()}
    rows = sorted((bool(labels[i]), features((t or "").encode()).tolist(), i) for i, t in corpus)
    x, good = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    want = brute.pairwise_scores(x, good, q.PAIRS, q.SEED, q.PENALTY, q.THRESHOLD)
    assert max(abs(got[i] - s) for (_, _, i), s in zip(rows, want, strict=True)) < 0.02


def test_all_pairs_of_labels_teach(spark, corpus, documents, monkeypatch):
    from tidemark.llm import quality_classifier as q

    labels = {i: int(i % 3 > 0) for i, _ in corpus}
    monkeypatch.setattr(q, "BLOCK", 16, raising=False)
    monkeypatch.setattr(q, "BINS", 4, raising=False)
    df = quality_scores(documents, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), lambda d: F.lit(True))
    got = {r["doc_id"]: r["score"] for r in df.collect()}
    x, good = np.array([features((t or "").encode()) for _, t in corpus]), np.array([labels[i] for i, _ in corpus])
    want = brute.all_pairs_scores(x, good, 1 - good, q.PENALTY, q.THRESHOLD)
    assert max(abs(got[i] - s) for (i, _), s in zip(corpus, want, strict=True)) < 1e-5


def test_all_of_many_labels_teach(spark, corpus):
    from tidemark.llm import quality_classifier as q

    texts = [t or "" for _, t in corpus if len(t or "") < 1000]
    x = np.array([features(t.encode()) for t in texts])
    draw = random.Random(5)
    taught = [(i, draw.randrange(len(texts))) for i in range(25_000)]
    quality = [int(draw.random() < 0.2 + 0.6 * k / len(texts)) for _, k in taught]
    docs = spark.createDataFrame([(i, texts[k]) for i, k in taught], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for (i, _), y in zip(taught, quality, strict=True)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels, lambda d: F.lit(True)).collect()}
    good, bad = np.zeros(len(texts), int), np.zeros(len(texts), int)
    for (_, k), y in zip(taught, quality, strict=True):
        (good if y else bad)[k] += 1
    want = brute.all_pairs_scores(x, good, bad, q.PENALTY, q.THRESHOLD)
    assert len(got) == len(taught) and max(abs(got[i] - want[k]) for i, k in taught) < 1e-5


@pytest.mark.parametrize("text", [b"", b" \n", b"a", "é".encode() * 9, b"x" * 100_000, b"\n".join([b"same"] * 50), bytes(range(1, 128))])
def test_features_are_finite(text):
    assert np.isfinite(features(text)).all()


def test_written_tables_can_be_released(spark):
    import os

    from tidemark.llm import common

    df = common.materialize(spark.range(3), "test")
    assert df.count() == 3
    paths = [p.removeprefix("file://") for p in common._written]
    assert paths and all(map(os.path.exists, paths))
    common.release(spark)
    assert not any(map(os.path.exists, paths)) and not common._written


def test_tables_that_are_read_or_older_stay(spark):
    from tidemark.llm import common

    older = common.materialize(spark.range(2), "test")
    since = common.so_far()
    middle = common.materialize(spark.range(3), "test")
    last = common.materialize(middle.filter("id > 0"), "test")
    common.release(spark, keep=last, since=since)
    assert older.count() == 2 and last.count() == 2 and common.so_far() == since + 1
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|file_not_exist"):
        middle.count()
    common.release(spark, since=since)
    assert common.so_far() == since


def test_marks_miss_no_id(spark, monkeypatch):
    from tidemark.llm import common

    df = spark.range(5000).select((F.col("id") - 100).alias("doc_id"), F.lit(1).alias("bits"), F.lit(2).alias("at")).unionByName(spark.createDataFrame([(None, 1, 2)], "doc_id long, bits int, at int"))
    ids = df.filter("doc_id % 7 = 3").select(F.col("doc_id").alias("k"))
    for bits in (1 << 26, 64):
        monkeypatch.setattr(common, "MARKS", bits)
        sure, maybe = common.split_marked(df, "doc_id", common.marks(ids, "k"))
        assert sure.columns == maybe.columns == df.columns
        assert sure.filter("doc_id % 7 = 3").isEmpty() and maybe.filter("doc_id % 7 = 3").count() == ids.count()
        assert sure.count() + maybe.count() == 5001 and sure.filter("doc_id is null").count() == 1
        assert bits == 64 or maybe.count() < 1.05 * ids.count()
    sure, maybe = common.split_marked(df, "doc_id", common.marks(ids.limit(0), "k"))
    assert sure.count() == 5001 and maybe.count() == 0
