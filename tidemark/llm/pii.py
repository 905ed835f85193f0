"""Personal data by patterns and by bootstrapped contexts.

One scan over the texts finds the base matches of four kinds, long keys, and all
candidates, each with the words around it; what follows works on those few
columns. Candidates go by shape: words with a digit, numbers of several words, and
words without a digit that have a mark between letters, as addresses do.

Seeds are the valid base matches and at most SEED_KEYS keys. Each place of an
instance gives three lexical patterns: the two words before it; the words before
and after it; the word before it and the shape of what it is made of. Patterns and
instances form a graph that is scored in rounds. A pattern's confidence is its
good instances against those that speak against it: seeds of another kind, numbers
that fail their kind's check, and plain words that stand in the same context,
which a second scan counts over all texts. Instances of unknown kind don't count
for or against a context, but count against a pattern by shape. Instances of a
confident pattern are good in the next round; those that the last round's
patterns find are what no seed had.

Matches are marked by one replacement and split at the marks, which gives gaps and
matches in turn and so positions in code points. Patterns begin only where the
regular leftmost search would, by look-behind or at the last match's end, and use
possessive runs, so a long run of letters or digits is passed in linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind: (a character that any match has, pattern); the last is for keys.
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"),
    "card": ("", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": ("", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"),
}
#: Marks around a candidate that are no part of it.
_OPEN, _CLOSE = r"[\"'(\[{<]", r"[\"')\]}>.,;:!?#$%&*|]"
_END = rf"{_CLOSE}*+(?![^{SPACE}])"
_GROUP = r"\(*+[0-9][0-9()./-]*+"
_NEXT = rf"\x20++{_GROUP}(?={_END})"
#: Candidates by shape: words with a digit; numbers of several words (19 digits at most, so as many words); words without a digit.
TOKEN, NUMBER, NAME, BASE = range(4)
SHAPES = {
    TOKEN: rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+",
    NUMBER: rf"(?<![^{SPACE}])[\"'\[{{<]*+\+?{_GROUP}(?:{_NEXT}){{1,18}}+(?!{_NEXT})",
    NAME: rf"(?<![^{SPACE}])(?=[^{SPACE}0-9]++(?![^{SPACE}]))[^{SPACE}]*?\p{{L}}[@._%+(\[-]++\p{{L}}[^{SPACE}]*+",
}
#: What texts with such words have. Marks are tried first: most characters are none, so this passes a text many times faster than the shapes do.
_HAS_DIGIT, _HAS_NAME = "[0-9]", r"[@._%+(\[-](?<=\p{L}[@._%+(\[-])[@._%+(\[-]*+\p{L}"
MOST_DIGITS = 19
#: A word that looks like an identifier itself: contexts end there, and it stands in them as this mark.
_IDENTIFIER, _ANY = "[0-9@]", "#"
#: Characters at the end of a gap that are looked at first for the words before a match.
CONTEXT_CHARS = 120
#: Put around matches; a text's own are replaced by another control character, which no pattern tells from it.
_MARK, _OTHER = "\x01", "\x02"
#: Seeds beyond the base kinds: so many keys, those with the least hash.
SEED_KEYS = 32
ROUNDS = 3
CONFIDENCE = 0.8
LEAST_SEEDS = 3
#: More patterns than this are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: The part of the texts in which frequent contexts are told from rare ones.
PARTS = 64
#: Pattern types: words before; words around; word before and shape.
BEFORE, AROUND, FORMED = range(3)

_HITS = "array<struct<kind:int,i:int,gap:int,len:int,ok:boolean,core:string,left:struct<two:string,one:string>,right:string>>"
_CANDIDATES = "array<struct<shape:int,i:int,gap:int,token:string,left:struct<two:string,one:string>,right:string>>"


def luhn(digits: Column) -> Column:
    """True if the digits pass; the rightmost is not doubled."""
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), 0)

    def one(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(each, one), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(hit, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "secret":
        return F.rlike(hit, F.lit("[0-9]")) & F.rlike(hit, F.lit("[A-Fa-f]"))
    return F.lit(True)


def words_in(c: Column) -> Column:
    return F.filter(F.split(c, f"[{SPACE}]+", -1), lambda w: w != "")


def named(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def around(parts: Column, i: Column) -> tuple[Column, Column]:
    """(left, right): the last two words before match i, back to the last that looks like an identifier, and the first word after it.

    left has (two, one), null where there is none; right is empty at the end.
    """
    part = lambda k: F.coalesce(F.get(parts, 2 * i + k), F.lit(""))
    tail = lambda c: F.substring(c, -CONTEXT_CHARS, CONTEXT_CHARS)
    id_ = lambda w: F.rlike(w, F.lit(_IDENTIFIER))
    opened = lambda c: F.regexp_replace(c, f"{_OPEN}+$", "")
    # A match and the gap beside it have a word at least, so two matches back are enough for two words.
    whole = lambda: words_in(F.lower(F.concat(part(-3), part(-2), part(-1), opened(F.get(parts, 2 * i)))))

    def before(near: Column) -> Column:
        # The first of three words of the gap's end may be cut, the last two can't be; a gap with fewer is read whole.
        return named(F.when(F.size(near) >= 3, near).otherwise(whole()), last_two)

    def last_two(words: Column) -> Column:
        one, two = F.get(words, F.size(words) - 1), F.get(words, F.size(words) - 2)
        one_ = F.when(~id_(one), one)
        return F.struct(F.when(one_.isNotNull() & ~id_(two), two).alias("two"), one_.alias("one"))

    left = named(words_in(F.lower(opened(tail(F.get(parts, 2 * i))))), before)
    following = F.regexp_extract(part(2), rf"^{_CLOSE}*+[{SPACE}]*+([^{SPACE}]*+)", 1)
    shown = lambda w: F.when(w != "", F.when(id_(w), _ANY).otherwise(F.lower(w)))
    right = F.coalesce(named(following, shown), F.when(F.get(parts, 2 * i + 3).isNotNull(), _ANY).otherwise(""))
    return left, right


def each_match(text: Column, pattern: str, row: Callable[..., Column], schema: str) -> Column:
    """row(match, gap before it, its number, words before, word after) of all matches; the text is searched once."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)

    def rows(x: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(((F.size(x) - 3) / 2).cast("int"), F.lit(0)))
        each = F.transform(numbers, lambda i: row(F.get(x, 2 * i + 1), F.get(x, 2 * i), i, *around(x, i)))
        return F.when(F.size(x) > 1, each.cast(schema)).otherwise(F.array().cast(schema))

    return named(parts, rows)


def base_hits(text: Column) -> Column:
    """All matches of the base kinds and of keys, valid or not, with the length of the gap before each; valid ones with their text and words around."""

    def as_hit(number: int, kind: str) -> Callable[..., Column]:
        def hit(h: Column, gap: Column, i: Column, left: Column, right: Column) -> Column:
            ok = valid(kind, h)
            lengths = F.length(gap).alias("gap"), F.length(h).alias("len")
            seed = [F.when(ok, c).alias(n) for n, c in (("core", h), ("left", left), ("right", right))]
            return F.struct(F.lit(number).alias("kind"), i.cast("int").alias("i"), *lengths, ok.alias("ok"), *seed)

        return hit

    # Emails need no digit; texts without one are passed for all other kinds at once.
    each = {kind: each_match(text, pattern, as_hit(k, kind), _HITS) for k, (kind, (_, pattern)) in enumerate(PATTERNS.items())}
    none = F.array().cast(_HITS)
    guarded = {kind: F.when(F.contains(text, F.lit(must)), each[kind]).otherwise(none) if (must := PATTERNS[kind][0]) else each[kind] for kind in each}
    email = guarded.pop("email")
    return F.concat(email, F.when(F.rlike(text, F.lit(_HAS_DIGIT)), F.concat(*guarded.values())).otherwise(none))


def candidates(text: Column) -> Column:
    """Matches of each shape, with the gap before each and the words around it."""

    def as_candidate(shape: int) -> Callable[..., Column]:
        return lambda h, gap, i, left, right: F.struct(
            F.lit(shape).alias("shape"), i.cast("int").alias("i"), F.length(gap).alias("gap"), h.alias("token"), left.alias("left"), right.alias("right")
        )

    tokens, numbers, names = (each_match(text, SHAPES[k], as_candidate(k), _CANDIDATES) for k in (TOKEN, NUMBER, NAME))
    none = F.array().cast(_CANDIDATES)
    with_digits = F.when(F.rlike(text, F.lit(_HAS_DIGIT)), F.concat(tokens, numbers)).otherwise(none)
    return F.concat(with_digits, F.when(F.rlike(text, F.lit(_HAS_NAME)), names).otherwise(none))


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its number, doc_id, base hits and candidates."""
    # Not translate(), which is many times slower and would run once for each pattern.
    read = docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(_MARK), F.lit(_OTHER)).alias("text"))
    text = F.col("text")
    number = F.monotonically_increasing_id().alias("row")
    return materialize(read.select(number, "doc_id", base_hits(text).alias("hits"), candidates(text).alias("candidates")), "pii-scan")


def running(partition: list[Column | str]) -> Window:
    return Window.partitionBy(*partition).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def base_spans(scan: DataFrame) -> DataFrame:
    """(row, kind, start, stop, core, left, right) of the valid base matches and keys."""
    each = scan.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*")
    stop = F.sum(F.col("gap") + F.col("len")).over(running(["row", "kind"]))
    return each.withColumn("stop", stop).filter("ok").select("row", "kind", (F.col("stop") - F.col("len")).alias("start"), "stop", "core", "left", "right")


def instances(scan: DataFrame, base: DataFrame) -> DataFrame:
    """(row, start, stop, core, left, right, shape, kinds) of base matches and keys, and of candidates without the marks around them.

    kinds are those that an instance counts for: numbers of several words can be
    cards and phones, their single words neither, names addresses. A candidate that
    starts where a base match or a key does, or lies inside one, is that match, and
    one that holds a key is left to the key.
    """
    each = scan.filter(F.size("candidates") > 0).select("row", F.explode("candidates").alias("x")).select("row", "x.*")
    number = F.col("shape") == NUMBER
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("token")).over(running(["row", "shape"])))
    opened = F.when(number, F.regexp_extract("token", r"^[\"'\[{<]*+", 0)).otherwise(F.regexp_extract("token", rf"^{_OPEN}*+", 0))
    # Greedy or by the last of the closing marks: a lazy search would pass a long token once for each of its characters.
    bare = F.regexp_replace(F.expr("substr(token, length(opened) + 1)"), rf"(?<!{_CLOSE}){_CLOSE}++$", "")
    inner = F.when(number, F.regexp_extract("token", r"^[\"'\[{<]*+(.*[0-9])", 1)).otherwise(bare)
    each = each.withColumn("opened", opened).withColumn("core", inner)
    each = each.withColumn("start", F.col("end") - F.length("token") + F.length("opened"))
    each = each.withColumn("stop", F.col("start") + F.length("core")).filter(F.length("core") >= 1)
    each = each.filter(~number | (F.length(F.regexp_replace("core", "[^0-9]", "")) <= MOST_DIGITS))
    each = each.filter(number | ~F.rlike("core", F.lit(PATTERNS["secret"][1])))
    names = ["row", "start", "stop", "core", "left", "right", "shape"]
    every = each.select(*names).unionByName(base.withColumn("shape", F.lit(BASE)).select(*names).distinct())
    so_far = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    until = lambda shape: F.max(F.when(F.col("shape") == shape, F.col("stop"))).over(so_far)
    starts = F.max(F.when(F.col("shape") == BASE, F.col("start"))).over(so_far)
    every = every.withColumns({"based": until(BASE), "at": starts, "numbered": until(NUMBER)})
    same = (F.col("based") >= F.col("stop")) | (F.col("at") == F.col("start"))
    every = every.filter((F.col("shape") == BASE) | ~F.coalesce(same, F.lit(False)))
    kinds = lambda *names: F.array(*[F.lit(k) for k, kind in enumerate(PATTERNS) if kind in names])
    of_shape = (
        F.when(F.col("shape") == NUMBER, kinds("card", "phone"))
        .when(F.col("shape") == NAME, kinds("email"))
        .when((F.col("shape") == TOKEN) & (F.col("numbered") >= F.col("stop")), kinds("email", "ip", "secret"))
        .otherwise(kinds(*PATTERNS))
    )
    return every.select(*names, of_shape.alias("kinds"))


def form(core: Column) -> Column:
    """What a text is made of: kinds of letters, digits, its marks, and its length by powers of two."""
    has = lambda pattern, shown: F.when(F.rlike(core, F.lit(pattern)), shown).otherwise("")
    marks = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(core, F.lit(r"[^\p{L}\p{N}]"), 0))), "")
    return F.concat(has(r"\p{Ll}", "a"), has(r"\p{Lu}", "A"), has("[0-9]", "9"), marks, F.lit(":"), F.floor(F.log2(F.length(core))).cast("string"))


def pattern_key(kind: int, *parts: Column) -> Column:
    """A hash of the type and its parts; nulls are left out."""
    return F.xxhash64(F.lit(kind), *parts)


def patterns_of(found: DataFrame) -> DataFrame:
    """found with `patterns`: (type, key) of up to three for each place."""
    one = lambda kind, has, *parts: F.when(has, F.struct(F.lit(kind).alias("type"), pattern_key(kind, *parts).alias("pattern")))
    has, last = F.col("left.one").isNotNull(), F.col("left.one")
    each = (
        one(BEFORE, has, F.col("left.two"), last),
        one(AROUND, has & (F.col("right") != ""), last, F.col("right")),
        one(FORMED, has, last, form(F.col("core"))),
    )
    return found.withColumn("patterns", F.filter(F.array(*each), lambda x: x.isNotNull()))


def context_places(docs: DataFrame) -> DataFrame:
    """(pattern) of each word of the texts: the words before it, and those around it."""
    # Words that look like identifiers are one mark; most texts have none.
    text = F.lower(F.coalesce("text", F.lit("")))
    marked = F.regexp_replace(text, rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+", _ANY)
    whole = F.when(F.rlike(text, F.lit(_IDENTIFIER)), marked).otherwise(text)
    words = F.split(F.btrim(whole, F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE}]+", -1)

    def contexts(w: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            one, two, following = F.get(w, i - 1), F.get(w, i - 2), F.get(w, i + 1)
            before = F.when(two == _ANY, pattern_key(BEFORE, one)).otherwise(pattern_key(BEFORE, two, one))
            return F.when(one != _ANY, F.array(before, F.when(following.isNotNull(), pattern_key(AROUND, one, following))))

        return F.transform(w, at)

    each = docs.select(F.explode(named(words, contexts)).alias("x"))
    return each.select(F.explode("x").alias("pattern")).filter("pattern is not null")


def context_totals(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, total): how many words of all texts stand in each wanted (pattern) context."""
    each = context_places(docs)
    if wanted.count() <= BROADCAST_ROWS:
        each = each.join(F.broadcast(wanted), "pattern", "left_semi")
        return each.groupBy("pattern").agg(F.count("*").alias("total"))
    return each.groupBy("pattern").agg(F.count("*").alias("total")).join(wanted, "pattern")


def graph(found: DataFrame, seeds: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (kind, type, pattern, instance, against) and patterns (kind, type, pattern, n, plain).

    found is instances(); seeds (kind, core). Only patterns of LEAST_SEEDS different
    instances are there, as no others can come to count, and none in whose context
    so many plain words stand that no score of its instances could make it
    confident. Edges are distinct, so a pattern before a third of all candidates
    costs as many rows as it has different instances.
    """
    placed = patterns_of(found).select(F.explode("patterns").alias("p"), "core", "kinds").select("p.*", "core", F.xxhash64("core").alias("instance"), "kinds")
    places = placed.groupBy("type", "pattern").agg(F.count("*").alias("places"))
    distinct = placed.groupBy("type", "pattern", "instance").agg(F.min("core").alias("core"), F.first("kinds").alias("kinds"))
    each = distinct.select("type", "pattern", "instance", "core", F.explode("kinds").alias("kind"))
    of_pattern = each.groupBy("type", "kind", "pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_SEEDS)
    of_pattern = materialize(of_pattern.join(places, ["type", "pattern"]), "pii-supported")
    of_pattern = materialize(with_plain(of_pattern, docs), "pii-plain")

    own = seeds.select(F.xxhash64("core").alias("instance"), F.col("kind").alias("seed_kind")).distinct()
    known = own.groupBy("instance").agg(F.collect_set("seed_kind").alias("seed_kinds"))
    each = each.join(of_pattern.select("kind", "pattern"), ["kind", "pattern"]).join(known, "instance", "left")
    failing = F.lit(False)
    for kind, looks in (("ip", r"^[0-9]+(?:\.[0-9]+){3}$"), ("card", r"^[0-9](?:[\x20-]?[0-9]){11,18}$")):
        failing = failing | ((F.col("kind") == KINDS.index(kind)) & F.rlike("core", F.lit(looks)) & ~valid(kind, F.col("core")))
    other = F.size("seed_kinds") > 0
    against = F.coalesce(other & ~F.array_contains("seed_kinds", F.col("kind")), F.lit(False)) | failing
    return materialize(each.select("kind", "type", "pattern", "instance", against.alias("against")), "pii-edges"), of_pattern


def with_plain(of_pattern: DataFrame, docs: DataFrame) -> DataFrame:
    """of_pattern with `plain`, the places of its context with no candidate, without those that have too many for any score.

    A part of the texts shows that for frequent contexts, as their words there are
    some of those in all; the others are counted in all texts, which takes few rows.
    """
    least = F.greatest(F.coalesce("total", F.lit(0)) - F.col("places"), F.lit(0))
    hopeful = (F.col("type") == FORMED) | (F.col("n") / (F.col("n") + F.col("plain") + 1) >= CONFIDENCE)
    for part in (docs.filter(F.pmod(F.xxhash64("text"), F.lit(PARTS)) == 0), docs):
        wanted = materialize(of_pattern.filter(F.col("type") != FORMED).select("pattern").distinct(), "pii-wanted")
        counted = of_pattern.drop("plain").join(context_totals(part, wanted), "pattern", "left")
        counted = counted.withColumn("plain", F.when(F.col("type") == FORMED, 0).otherwise(least)).drop("total")
        of_pattern = materialize(counted.filter(hopeful), "pii-hopeful")
    return of_pattern


def confident_patterns(edges: DataFrame, of_pattern: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, pattern, confidence) of the patterns at or above CONFIDENCE after ROUNDS rounds."""
    seeded = materialize(seeds.select("kind", F.xxhash64("core").alias("instance"), F.lit(1.0).alias("score")).distinct(), "pii-seeds")
    good, scored = seeded, None
    for turn in range(ROUNDS):
        sums = (F.sum("score").alias("mass"), F.count("score").alias("good"), F.count_if(F.col("against") & F.col("score").isNull()).alias("bad"))
        found = edges.join(good, ["kind", "instance"], "left").groupBy("kind", "pattern").agg(*sums).filter(F.col("good") >= LEAST_SEEDS)
        against = F.when(F.col("type") == FORMED, F.col("n")).otherwise(F.col("good") + F.col("bad") + F.col("plain"))
        confidence = (F.col("mass") / (against + 1)).alias("confidence")
        scored = found.join(of_pattern, ["kind", "pattern"]).select("kind", "pattern", confidence).filter(F.col("confidence") >= CONFIDENCE)
        scored = materialize(scored, "pii-patterns")
        if turn + 1 < ROUNDS:
            lifted = edges.join(scored, ["kind", "pattern"]).select("kind", "instance", F.col("confidence").alias("score"))
            every = seeded.unionByName(lifted)
            good = materialize(every.groupBy("kind", "instance").agg(F.max("score").alias("score")), "pii-good")
    return scored


def learnt(docs: DataFrame, scan: DataFrame, seed_keys: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Base spans with keys, instances, seeds (kind, core) and confident patterns."""
    base = materialize(base_spans(scan), "pii-base")
    found = materialize(instances(scan, base), "pii-instances")
    # At most seed_keys rows.
    keys = base.filter(F.col("kind") == SECRET).select("kind", "core").distinct().orderBy(F.xxhash64("core"), "core").limit(seed_keys)
    seeds = materialize(base.filter(F.col("kind") < SECRET).select("kind", "core").distinct().unionByName(keys), "pii-all-seeds")
    return base, found, seeds, confident_patterns(*graph(found, seeds, docs), seeds)


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(row, kind, start, stop) of instances in a confident pattern; of several kinds the surest."""
    wide = patterns_of(found).select("row", "start", "stop", "kinds", F.explode("patterns.pattern").alias("pattern"))
    small = patterns.count() <= BROADCAST_ROWS
    hits = wide.join(F.broadcast(patterns) if small else patterns, "pattern").filter(F.array_contains("kinds", F.col("kind")))
    best = F.max(F.struct("confidence", "kind")).alias("best")
    return hits.groupBy("row", "start", "stop").agg(best).select("row", F.col("best.kind").alias("kind"), "start", "stop")


def personal_data(docs: DataFrame, seed_keys: int = SEED_KEYS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no spans (the hash of the empty string). Spans of
    the method are a base kind with `_like`, or `secret`, for what its contexts
    discover and for the seed_keys keys that it starts from; a `_like` that meets a
    base span, and a `secret` inside one, is left out. Repeated rows, and rows with a null doc_id, are scanned each;
    instances are counted once, however many rows have them. Very long texts, words
    and numbers are scanned whole, in linear time. An empty table gives an empty result.
    """
    scan = scanned(docs)
    every, found, seeds, patterns = learnt(docs, scan, seed_keys)
    base = every.filter(F.col("kind") < SECRET)
    # Few rows: at most seed_keys different keys.
    keys = every.filter(F.col("kind") == SECRET).join(F.broadcast(seeds.filter(F.col("kind") == SECRET)), ["kind", "core"], "left_semi")
    more = discovered(found.filter((F.col("shape") != BASE) | F.array_contains("kinds", F.lit(SECRET))), patterns)
    more = more.unionByName(keys.select("row", "kind", "start", "stop")).groupBy("row", "start", "stop").agg(F.max("kind").alias("kind"))
    both = base.select("row", "kind", "start", "stop").withColumn("base", F.lit(True)).unionByName(more.withColumn("base", F.lit(False)))
    # A span of the method meets a base span if one from before ends after its start, or one from here on starts before its end.
    # Both are running values, the second from the end: a frame to the end would pass all later rows for each row.
    so_far, from_here = (
        Window.partitionBy("row").orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow) for by in (F.col("start"), F.col("start").desc())
    )
    until = F.max(F.when(F.col("base"), F.col("stop"))).over(so_far)
    met = (until > F.col("start")) | (F.min(F.when(F.col("base"), F.col("start"))).over(from_here) < F.col("stop"))
    # Runs of digits in a key can pass for a card; it stays unless a base span has all of it.
    gone = F.when(F.col("kind") == SECRET, until >= F.col("stop")).otherwise(met)
    both = both.withColumn("gone", F.coalesce(gone, F.lit(False))).filter("base or not gone")
    of_row = both.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "base"))).alias("all"))
    of_row = of_row.withColumn("own", F.filter("all", lambda x: x["base"]))
    names = {True: F.array(*[F.lit(k) for k in KINDS], F.lit("secret")), False: F.array(*[F.lit(f"{k}_like") for k in KINDS], F.lit("secret"))}

    def shown(spans: str) -> Column:
        name = lambda x: F.element_at(F.when(x["base"], names[True]).otherwise(names[False]), x["kind"] + 1)
        one = lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["stop"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    count_of = lambda k: F.size(F.filter("own", lambda x: x["kind"] == k)).cast("long")
    counts = [count_of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    out = scan.select("row", "doc_id").join(of_row, "row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,base:boolean>>")
    out = out.withColumn("own", F.coalesce("own", none)).withColumn("all", F.coalesce("all", none))
    return out.select("doc_id", *counts, F.sha2(shown("own"), 256).alias("base_sha256"), shown("all").alias("spans"), F.size("all").cast("long").alias("n_spans"))
