"""Licence scans by a positional index of rare words.

One pass tokenises the texts and keeps, for each, which licence words it has; that
gives each word its IDF over all documents. The index holds the postings (word,
template, position) of each template's rarest words: so many that a place which
may lack the others must have one of them. Only texts that have all words of some
mandatory key phrase are looked at further. Their words in the index are joined to
the postings, which gives starts by relative position; the template's other words
are intersected at their places, and the key phrase is verified. Base phrases are
templates that must stand whole, so none is missed. Places are found in blocks of
words, so no text makes a large row; nothing but places and numbers is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: All characters but \x00-\x2F, \x3A-\x60 and \x7B-\x7F. Java tests a class that is stated
#: by what it has many times faster than a negated union of ranges.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
#: (phrase, label) of the base scan.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (template, mandatory key phrase in it, label) of the method.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache license", "apache-2.0"),
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", "mit"),
    ("licensed under the gnu general public license version 3", "general public license", "gpl-3"),
    ("licensed under the gnu general public license version 2", "general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl-2.0"),
    ("licensed under a creative commons attribution license", "creative commons attribution", "cc-by"),
    ("licensed under a creative commons attribution sharealike license", "attribution sharealike", "cc-by-sa"),
)
#: Least share of a template's words that must stand at their places.
LEAST_SHARE = 0.75


#: Words of a block that is searched at a time.
BLOCK_WORDS = 1024
#: Postings that are broadcast, at most, each with its template; more are joined by a shuffle.
BROADCAST_ROWS = 20_000
POSTINGS = "word string, form int, pos int, template array<string>, key_at int, key_words int, least double, label string, base boolean"


def words_of(text: Column) -> Column:
    """The words, with A-Z in lower case; what is beyond ASCII may change its case too, but never becomes ASCII.

    Of all other characters only the Kelvin sign has a lower case in ASCII; the one
    put in its place has none. translate() would be many times slower.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), 0)


def forms_of(base, templates, least_share: float) -> list[tuple[list[str], int, int, float, str, bool]]:
    """(words, where the key phrase is in them, its words, least share, label, whether it is of the base scan)."""
    forms = [(p.split(), 0, len(p.split()), 1.0, label, True) for p, label in base]
    for template, key, label in templates:
        words, needed = template.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(needed)] == needed)
        forms.append((words, at, len(needed), least_share, label, False))
    return forms


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokenised(docs: DataFrame, forms) -> DataFrame:
    """(row, doc_id, n_words, present, words): the licence words of each text, and all of its words if it has those of a key phrase."""
    vocabulary = sorted({w for words, *_ in forms for w in words})
    keys = F.array(*[literal(sorted(set(words[at : at + n]))) for words, at, n, *_ in forms])
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    read = read.withColumn("present", F.array_intersect("words", literal(vocabulary)))
    may = F.exists(keys, lambda key: F.size(F.array_except(key, F.col("present"))) == 0)
    return read.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "present", F.when(may, F.col("words")).alias("words"))


def rarity(scan: DataFrame) -> dict[str, float]:
    """IDF of each licence word over all documents; as many rows as the templates have words."""
    counts = {r["word"]: r["n"] for r in scan.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    most = max(counts.values(), default=0)
    return {w: math.log((1 + most) / (1 + n)) for w, n in counts.items()}


def rare_postings(forms, idf: dict[str, float]) -> list[tuple]:
    """The postings of each form's rarest words. A place that counts lacks fewer words than are posted, so it has one of them."""
    out = []
    for k, (words, key_at, key_words, least, label, is_base) in enumerate(forms):
        lacking = math.floor(len(words) - least * len(words) + 1e-9)
        rare = sorted(range(len(words)), key=lambda i: (-idf.get(words[i], math.inf), words[i], i))[: lacking + 1]
        out += [(words[i], k, i, words, key_at, key_words, least, label, is_base) for i in sorted(rare)]
    return out


def places(scan: DataFrame, postings: list[tuple]) -> DataFrame:
    """(row, form, start, share, label, base) of each place that counts, once."""
    spark = scan.sparkSession
    longest = max(len(p[3]) for p in postings)
    margin = longest - 1
    rare = sorted({p[0] for p in postings})
    words, k = F.col("words"), F.col("k")
    texts = scan.filter("words is not null").select("row", "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / BLOCK_WORDS).cast("int"))).alias("k"))
    before = F.least(k * BLOCK_WORDS, F.lit(margin))
    blocks = texts.select("row", (k * BLOCK_WORDS - before).alias("first"), before.alias("before"), F.slice(words, k * BLOCK_WORDS - before + 1, before + BLOCK_WORDS + margin).alias("block"))

    def seen(w: Column, j: Column) -> Column:
        own = (j >= F.col("before")) & (j < F.col("before") + BLOCK_WORDS)
        near = F.transform(F.sequence(F.lit(-margin), F.lit(margin)), lambda d: F.get("block", j + d))
        return F.when(own & w.isin(rare), F.struct((F.col("first") + j).alias("at"), w.alias("word"), near.alias("near")))

    hits = blocks.select("row", F.explode(F.filter(F.transform("block", seen), lambda x: x.isNotNull())).alias("x")).select("row", "x.*")
    index = spark.createDataFrame(postings, POSTINGS)
    found = hits.join(F.broadcast(index) if len(postings) <= BROADCAST_ROWS else index, "word")
    stands = F.transform("template", lambda w, t: F.coalesce(F.get("near", margin + t - F.col("pos")) == w, F.lit(False)))
    found = found.withColumn("stands", stands)
    share = F.size(F.filter("stands", lambda x: x)) / F.size("template")
    keyed = F.forall(F.slice("stands", F.col("key_at") + 1, F.col("key_words")), lambda x: x)
    found = found.withColumns({"share": share, "keyed": keyed}).filter("keyed and share >= least")
    start = (F.col("at") - F.col("pos")).cast("long")
    one = (F.first("share").alias("share"), F.first("label").alias("label"), F.first("base").alias("base"))
    return found.groupBy("row", "form", start.alias("start")).agg(*one)


def license_scan(docs: DataFrame, base=BASE, templates=TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    docs has doc_id and text; other columns are ignored. A template counts where at
    least least_share of its words stand at their places, its key phrase (the first
    place of it in the template) among them. Null and empty texts have no words, no
    labels (empty strings) and score 0. score is the largest share of a template's
    words found with its key phrase, 1 for a base phrase. Repeated rows, and rows
    with a null doc_id, are scanned each. Very long texts are scanned whole, in
    blocks of words that overlap by a template's length. An empty table gives an
    empty result; without phrases and templates nothing is found.
    """
    forms = forms_of(base, templates, least_share)
    scan = materialize(tokenised(docs, forms or [(["\x00"], 0, 1, 1.0, "", True)]), "license-scan")
    postings = rare_postings(forms, rarity(scan)) or [("\x00", 0, 0, ["\x00"], 0, 1, 1.0, "", True)]
    found = places(scan, postings)
    of_base = lambda c: F.when(F.col("base"), F.col(c))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    of_row = found.groupBy("row").agg(
        F.count_if("base").alias("n_base"), F.min(of_base("start")).alias("first_word"), F.max(of_base("start")).alias("last_word"),
        labels(of_base("label")).alias("base_labels"), labels("label").alias("labels"), F.max("share").alias("score"),
    )
    out = scan.select("row", "doc_id", "n_words").join(of_row, "row", "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = out.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
