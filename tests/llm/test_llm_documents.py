import collections
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import license_scan, pii, quality_rules
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.near_dedup import near_dedup, shingle_set, superminhash


def by_id(df, *columns):
    rows = df.select("doc_id", *columns).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_quality_rules(clashing, corpus):
    got = by_id(quality_rules.quality_rules(clashing), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = {i: brute.quality(t, quality_rules.NGRAM_LIMITS, quality_rules.LINE_LIMIT) for i, t in corpus}
    assert got == want
    assert {x[-2:] for x in want.values()} >= {(True, False), (False, True)}


def test_the_method_drops_texts_that_the_base_rule_keeps(spark):
    fresh = (f"w{i}" for i in range(10_000))
    words = lambda n: " ".join(next(fresh) for _ in range(n))
    sentence, heading = words(20), words(2)
    texts = {
        1: f"{sentence} {words(50)} {sentence}",  # 20 of 90 words again
        2: f"{sentence} {words(160)} {sentence}",  # 10 of 200
        3: "\n".join(f"{heading}\n{words(5)}" for _ in range(12)),  # 22 of 84 words in lines again
        4: "\n".join(f"{heading}\n{words(9)}" for _ in range(12)),  # 22 of 132
        5: words(60),
    }
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "base_failed", "kept")
    assert got == {1: (False, False), 2: (False, True), 3: (False, False), 4: (False, True), 5: (False, True)}


def test_quality_rules_of_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, "")]
    got = collections.Counter((r["doc_id"], r["kept"]) for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, True): 2, (None, True): 1, (None, False): 1, (2, False): 1}


def test_quality_filter_keeps_rows_as_they_are(clashing):
    kept = {r["doc_id"] for r in quality_rules.quality_rules(clashing).filter("kept").collect()}
    out = quality_rules.quality_filter(clashing)
    assert out.schema == clashing.schema and {r["doc_id"] for r in out.collect()} == kept


def test_windows_of_very_many_different_words_are_compared_exactly():
    import numpy as np

    ids = np.array([1 << 21, 5, 6, 7, 1 << 21, 5, 6, 8])
    keys = quality_rules.exact_trigrams(ids)
    assert keys[0] == keys[4] and len(set(keys.tolist())) == 5


@pytest.mark.parametrize(("short_texts", "least_hot"), [(False, 1000), (True, 1000), (False, 1)])
def test_line_dedup(clashing, corpus, monkeypatch, short_texts, least_hot):
    monkeypatch.setattr("tidemark.llm.line_dedup.LEAST_HOT", least_hot)  # with 1 a window of a few texts is a frequent one
    out = line_dedup(clashing, short_texts=short_texts)
    assert out.columns == [*clashing.columns, "n_lines", "n_removed"]
    want = brute.line_dedup(corpus, short_texts)
    assert by_id(out, "text", "n_lines", "n_removed") == want
    assert sum(x[2] > 0 for x in want.values()) > (40 if short_texts else 25)


def test_long_lines_are_windows_only_with_their_neighbours(spark):
    lines = lambda *ns: "\n".join(" ".join(f"w{n}x{i}" for i in range(n)) for n in ns)
    rows = [(1, lines(50, 51, 3)), (2, lines(51, 9, 50)), (3, lines(7, 50, 51, 3)), (4, lines(51)), (5, lines(51))]
    assert by_id(line_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed") == {1: (0,), 2: (0,), 3: (3,), 4: (0,), 5: (0,)}


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc"), (None, "a\nb\nc\nd"), (1, "a\nb\nc\nother")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[None, "a\nb\nc\nd"] == 1 and got[2, "x"] == 1 and got[1, ""] == 2 and got[1, "other"] == 1
    rows = [(None, "a\nb\nc\nd"), (None, "a\nb\nc"), (None, "a\nb\nc\nd"), (None, None), (4, "x\ny\nz\nx\ny\nz\nx\ny\nz")]
    got = collections.Counter((r["doc_id"], r["n_removed"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Of the two texts without an id one comes first, by its hash, on each of its rows.
    assert got in ({(None, 0): 3, (None, 3): 1, (4, 6): 1}, {(None, 0): 2, (None, 3): 2, (4, 6): 1})


def test_near_dedup(clashing, corpus):
    want = brute.near_components(corpus)
    assert by_id(near_dedup(clashing), "n_shingles", "component_id", "kept") == want
    assert sum(not x[2] for x in want.values()) > 40


def test_near_dedup_of_large_buckets(documents, corpus, monkeypatch):
    """All buckets go the way of large ones, in blocks of a few rows."""
    monkeypatch.setattr("tidemark.llm.near_dedup.DENSE", 0)
    monkeypatch.setattr("tidemark.llm.near_dedup.BLOCK", 7)
    assert by_id(near_dedup(documents), "n_shingles", "component_id", "kept") == brute.near_components(corpus)


def test_near_dedup_of_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(3, long), (3, other), (2, other), (7, long), (7, long), (None, long), (None, "alone at last with no id"), (9, None), (9, "")]
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(3, 2, False): 2, (2, 2, True): 1, (7, 2, False): 2, (None, 2, False): 1, (None, None, True): 1, (9, 9, True): 2}


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        both = rng.integers(0, 2**63, 900).astype(np.uint64)
        k = int(900 * share)
        a, b = both[: k + (900 - k) // 2], np.concatenate([both[:k], both[k + (900 - k) // 2 :]])
        agree = (superminhash(np.unique(a)) == superminhash(np.unique(b))).mean()
        assert abs(agree - share) < 0.14
    assert len(shingle_set(b"")) == 0 and len(shingle_set(b"a b")) == 1


def test_license_scan(clashing, spark):
    texts = {
        1: "CC BY cc by-cc,BY", 2: "The General  Public\nLicense. All rights reserved", 3: "", 4: None, 5: "all rights all rights reserved",
        6: "Licensed under the Apache License, Version 2.0.", 7: "licensed under that Apache licence", 8: "Released under the MIT License.", 9: "cc " * 3000 + "by", 10: "K cc by",
        11: "This work is licensed under the GNU General Public License, version 3.", 12: "ccé by cc by", 13: "MIT LI\u0130 all rights reserved \u0130 ÉÉ",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("rare", F.lit(2))
    out = license_scan.license_scan(df)
    assert by_id(out, "n_words", "n_base", "first_word", "last_word", "base_labels") == {i: brute.license_base(t) for i, t in texts.items()}
    labels = by_id(out, "labels", "score")
    assert labels[6] == ("apache-2.0", 1.0) and labels[7] == ("", 0.0) and labels[8] == ("mit", 1.0) and labels[2] == ("gpl,reserved", 1.0) and labels[4] == ("", 0.0)
    assert labels[11][0] == "gpl,gpl-3"
    assert license_scan.license_scan(clashing).count() == clashing.count()


def test_a_template_counts_with_any_word_altered_but_of_its_key_phrase(spark):
    """Each word of each template in turn, two at a time, and templates cut by the text's ends."""
    texts = []
    for template, _, _ in license_scan.TEMPLATES:
        w = template.split()
        texts += [" ".join(["x"] * 3 + w[:i] + ["altered"] + w[i + 1 :]) for i in range(len(w))]
        texts += [" ".join(w[:i] + ["altered"] + w[i + 1 : -1] + ["altered"]) for i in range(len(w) - 1)]
        texts += [" ".join(w[1:]), " ".join(w[:-1]), f"{template} {template}"]
    texts += ["Released under the MIT License", *["licensed under the MIT License"] * 3, "released under the license", None, ""]
    got = by_id(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "labels", "score")
    want = {i: brute.licenses(t, license_scan.BASE, license_scan.TEMPLATES, license_scan.LEAST_SHARE) for i, t in enumerate(texts)}
    assert got == want
    assert sum(0.75 <= s < 1 for _, s in want.values()) >= 100


def test_license_scan_of_many_templates_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BLOCK_WORDS", 16)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmno")
    templates = [(" ".join(t), " ".join(t[k : k + 2]), f"l{n}") for n in range(80) for t in [[word() for _ in range(rng.randint(3, 9))]] for k in [rng.randrange(len(t) - 1)]]
    texts = []
    for _ in range(60):
        w = [word() for _ in range(rng.randint(0, 120))]
        for t, _, _ in rng.sample(templates, 3):
            at = rng.randint(0, len(w))
            w[at:at] = [x if rng.random() < 0.9 else word() for x in t.split()]
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(license_scan.license_scan(df, templates=templates), "labels", "score")
    want = {i: brute.licenses(t, license_scan.BASE, templates, 0.75) for i, t in enumerate(texts)}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert {i: x[1] for i, x in got.items()} == pytest.approx({i: x[1] for i, x in want.items()})


def test_license_scan_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "cc by"), (1, "cc by"), (None, "cc by"), (None, None), (2, "cc " * 5000 + "by")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_base"], r["first_word"], r["labels"]) for r in license_scan.license_scan(df).collect())
    assert got == {(1, 1, 0, "cc-by"): 2, (None, 1, 0, "cc-by"): 1, (None, 0, None, ""): 1, (2, 1, 4999, "cc-by"): 1}
    nothing = license_scan.license_scan(df, base=(), templates=()).collect()
    assert {r["labels"] for r in nothing} == {""} and len(nothing) == 5


PII_TEXTS = {
    1: "a@b.c_d@e.fg x 1.2.3.4.5.6.7.8 999.1.1.1", 2: "4111 1111 1111 1111, +44 (0) 1234-5678-9 +1 22", 3: "4111-1111-1111-1111 4111111111111112 00000000000000",
    4: "😀 x@y.zz 😀 +12 345 678 901", 5: "", 6: None, 7: "1" * 30_000, 8: "1 " * 5000, 9: "a.b@c.d.e.f..g 1.2.3.4 +1(2)3.4-5 6 7 8 9 0 1 2\n+123456789x", 10: "@@ a@ @b.c a@b a@b. a@b.-", 11: "0001.002.3.4 1.2.3.256 256.1.2.3.4",
    12: "x" * 100_000 + "@b.co", 13: "1.1" * 20_000, 14: "é1.2.3.4é +1 23456789é",
}


def test_personal_data(spark, clashing):
    df = spark.createDataFrame(list(PII_TEXTS.items()), "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("hits", F.lit(1))
    got = by_id(pii.personal_data(df), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = {i: brute.pii_base(t)[:5] for i, t in PII_TEXTS.items() if i != 12} | {12: (1, 0, 0, 0, got[12][4])}
    assert got == want
    assert pii.personal_data(clashing).count() == clashing.count()


def test_contexts_discover_identifiers(spark):
    key = "0a1b2c3d" * 5
    texts = [f"my account mail {c}{c}@x.org is here" for c in "abcdefghijklmnopqrst"]
    texts += ["my account mail user77-at-x is here", "mail of user88-at-x is here", f'token = "{key}" x', f'TOKEN="{key.upper()}"', f"{key}g and {'0' * 40}"]
    got = by_id(pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "spans")
    assert got[20] == ("email_like:16:27",) and got[21] == ("",) and got[0] == ("email:16:24",)
    # Keys are found within words, in either case, but not as a part of longer ones.
    assert got[22] == ("secret:9:49",) and got[23] == ("secret:7:47",) and got[24] == ("",)


def keyed_texts():
    """Texts of which 60 have a key after the same words, 30 a name where a key could be, and 40 a number after other words."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("the of and hen tion ander lich vor ation ent".split()) for _ in range(n))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'{prose(30)} token = "{key()}" {prose(30)}' for _ in range(60)]
    texts += [f"{prose(20)} {rng.randint(10**15, 10**16)} {prose(20)}" for _ in range(40)]
    return [*texts, *(prose(50) for _ in range(30)), f'{prose(5)} token = "hunter_2" {prose(5)}', f"{prose(9)} {key()} {prose(9)}"]


def test_keys_are_found_by_discovered_patterns(spark):
    texts = keyed_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.personal_data(df, seed_keys=6), "spans", "n_spans")
    planted = {i: f"secret:{texts[i].index(chr(34)) + 1}:{texts[i].index(chr(34)) + 41}" for i in range(60)}
    assert all(planted[i] in got[i][0] for i in planted)  # 6 of 61 keys are seeds
    assert "secret" in got[130][0]  # what stands there and is no key
    assert sum("secret" in got[i][0] for i in range(60, 130)) == 0
    assert got[131][0] == "" or "secret" in got[131][0]  # a key elsewhere is found only as a seed
    assert all(n == len([x for x in s.split(",") if x]) for s, n in got.values())
    few = by_id(pii.personal_data(df, seed_keys=2), "spans")  # too few to teach
    assert sum("secret" in s for (s,) in few.values()) == 2


@pytest.mark.parametrize("parts", [64, 1])
def test_scoring_rounds_are_those_of_the_plain_form(spark, monkeypatch, parts):
    monkeypatch.setattr(pii, "PARTS", parts)
    texts = [*keyed_texts(), *(f"call {'us' if i % 3 else 'them'} +1 (017) 555-77{i} now" for i in range(10, 30)), "call us today", "call us (018) 555-7799 now", "call us 1.2.3.4 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scan = pii.scanned(docs)
    _, found, seeds, patterns = pii.learnt(docs, scan, 6)
    rows = pii.patterns_of(found).select("core", "left", "right", "kinds", pii.form(F.col("core")).alias("form"), F.explode("patterns").alias("p")).select("*", "p.*").collect()
    wrong = lambda x: {1} & {1 for y in [x] if len(y.split(".")) == 4 and y.replace(".", "").isdigit() and any(int(z) > 255 for z in y.split("."))} | ({2} if y_card(x) else set())
    y_card = lambda x: x.replace(" ", "").replace("-", "").isdigit() and 12 <= len(x.replace(" ", "").replace("-", "")) <= 19 and not brute.luhn(x.replace(" ", "").replace("-", ""))
    words = lambda left: " ".join(filter(None, (left["two"], left["one"])))
    named = {r["pattern"]: (("before", words(r["left"])), ("around", r["left"]["one"], r["right"]), None)[r["type"]] for r in rows}
    totals = brute.context_words(texts)
    occurrences = [(r["type"], r["pattern"], r["core"], r["kinds"], wrong(r["core"])) for r in rows]
    own = {(r["kind"], r["core"]) for r in seeds.collect()}
    want = brute.confident(occurrences, {p: totals[c] for p, c in named.items() if c}, own, pii.LEAST_SEEDS, pii.ROUNDS, pii.CONFIDENCE, pii.FORMED)
    got = {(r["kind"], r["pattern"]): r["confidence"] for r in patterns.collect()}
    assert got == pytest.approx(want) and len(want) > 4


def test_personal_data_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "x a@b.co y"), (1, "x a@b.co y"), (None, "x a@b.co y"), (None, None), (2, "")]
    got = collections.Counter((r["doc_id"], r["spans"], r["n_email"]) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, "email:2:8", 1): 2, (None, "email:2:8", 1): 1, (None, "", 0): 1, (2, "", 0): 1}


def test_many_matches_in_one_text(spark):
    text = " ".join(f"1.2.{i % 250}.{i // 250} u{i}@x.org" for i in range(20_000))
    r = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_ip"], r["n_email"], r["base_sha256"]) == (20_000, 20_000, brute.pii_base(text)[4])


def test_seeds_of_several_words_and_without_a_digit_teach_contexts(spark):
    texts = [f"please call us {x}+1 (017) 555-77{i}, thanks" for i, x in enumerate(["", "", '"', "("] * 5, start=10)]
    cards = [f"4{i:03d} 1111 1111 111" for i in range(100, 120)]
    texts += [f"paid by card {c}{next(d for d in '0123456789' if brute.luhn((c + d).replace(' ', '')))} today" for c in cards]
    texts += [f"my e-mail is {c}{c}.smith@example.com now" for c in "abcdefghijklmnopqrst"]
    at = len(texts)
    texts += ["please call us (018) 555-7799 now", "paid by card 4111 1111 1111 1112 now", "my e-mail is jane.smith(at)example now", "my e-mail is gone now", "who is jane.smith(at)example"]
    got = by_id(pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "spans")
    assert [got[at + k][0] for k in range(5)] == ["phone_like:15:29", "card_like:13:32", "email_like:13:34", "", ""]
    assert got[0] == ("phone:15:32",) and "_like" not in "".join(got[i][0] for i in range(at))


@pytest.mark.parametrize("f", [quality_rules.quality_rules, quality_rules.quality_filter, line_dedup, near_dedup, license_scan.license_scan, pii.personal_data])
def test_empty_tables(f, documents):
    assert f(documents.limit(0)).count() == 0


def test_no_pair_just_above_the_threshold_is_lost():
    """Of many pairs with a similarity of 0.75 or a little more, all share a band and agree in enough slots."""
    import numpy as np

    from tidemark.llm import near_dedup as near

    rng = np.random.default_rng(11)
    lost = 0
    for _ in range(1500):
        n = int(rng.integers(40, 400))
        both = int(np.ceil(0.75 * n))
        hashes = rng.integers(1, 2**63, n).astype(np.uint64)
        a, b = (superminhash(np.sort(x)) for x in (hashes[: both + (n - both) // 2], np.concatenate([hashes[:both], hashes[both + (n - both) // 2 :]])))
        bands = (a.reshape(near.BANDS, -1) == b.reshape(near.BANDS, -1)).all(axis=1)
        lost += not bands.any() or (a == b).sum() < near.LEAST_AGREE
    assert lost == 0


def test_near_dedup_of_frequent_pivots_and_further_turns(documents, corpus, monkeypatch):
    """Few pairs a task, all buckets large, and blocks of few shingles."""
    for name, value in (("PIVOT_PAIRS", 2), ("HOT_PIVOTS", 10**9), ("DENSE", 3), ("BLOCK", 5), ("BLOCK_SHINGLES", 300), ("JOINED", 0.0)):
        monkeypatch.setattr(f"tidemark.llm.near_dedup.{name}", value)
    assert by_id(near_dedup(documents), "n_shingles", "component_id", "kept") == brute.near_components(corpus)
