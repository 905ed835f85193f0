"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. Each text gives its set of 5-word shingles as 64-bit hashes, a digest of the
   whole set and a SuperMinHash signature. Texts with equal sets become one class,
   and only its least doc_id goes on, so a group of copies of any size costs one row.
2. Bands of the signature put classes into buckets. A bucket gives no pairs of its
   members: each is compared with one pivot, drawn anew for each bucket. The
   pivot whose signature agrees best is verified on the full sets, and union-find
   joins what it links. Large buckets that still hold several components draw
   another pivot, as long as that joins many of them.
3. Only buckets that are then still open are looked at again: all of their
   signatures are compared there, in blocks of bounded size, and pairs that may be
   links of different components are verified on the full sets. So every pair that
   shares a bucket is either compared or already joined. A large bucket is given
   its texts and verifies on the spot, so no pairs are written for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BATCH, bounded_batches, map_batches, marks, materialize, split_marked, texts_as_bytes
from .components import components

SHINGLE = 5
PERCENT = 75
SLOTS = 128
BANDS = 32
#: Slots that must agree before sets are compared; a pair at the threshold has 96 on average, with a deviation of 5 at most.
LEAST_AGREE = 64
#: Buckets of more members are compared where their texts are, in blocks of two times BLOCK rows or BLOCK_SHINGLES, about.
DENSE = 64
BLOCK = 256
BLOCK_SHINGLES = 1_000_000
#: Further pivots that a large bucket draws, at most, while each round joins a quarter of what is open.
TURNS = 4
JOINED = 0.25
#: Pairs of one pivot that are verified in one task, about. Only HOT_PIVOTS pivots can have a HOT_PIVOTS-th part of all pairs.
PIVOT_PAIRS = 256
HOT_PIVOTS = 10_000
#: Word hashes that a worker keeps.
WORDS_KEPT = 200_000
#: Shingles that are ranked at a time.
RANKED = 16_384

SIGNED = "doc_id long, n_shingles long, digest binary, sig binary"
_P = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hash_of = WordHashes()


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of the whole sequence where there are fewer words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    get = _hash_of.__getitem__
    hashes = np.fromiter(map(get, words), dtype=np.uint64, count=n)
    k = min(n, size)
    rolled = hashes[: n - k + 1].copy()
    for i in range(1, k):
        rolled *= _P
        rolled += hashes[i : n - k + 1 + i]
    return np.unique(mixed(rolled + np.uint64(k)))


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """16 bits of each slot of the SuperMinHash signature.

    In round j, element x puts its j-th random number, plus j, into slot p(j) of
    its own random permutation p, made by Fisher-Yates as far as needed. Once no
    slot is above the next round, no later number can be lower.
    """
    best = np.full(slots, np.inf)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), RANKED):
            part = elements[at : at + RANKED]
            rows = np.arange(len(part))
            order = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(part), slots)).copy()
            for j in range(slots):
                if best.max() <= j:
                    break
                drawn = mixed(part + np.uint64(j + 1) * _P)
                other = j + (drawn & np.uint64(0xFFFFFFFF)).astype(np.int64) % (slots - j)
                slot = order[rows, other]
                order[rows, other] = order[:, j]
                order[:, j] = slot
                np.minimum.at(best, slot, (drawn >> np.uint64(32)) * 2.0**-32 + j)
        return (mixed(best.view(np.uint64)) >> np.uint64(48)).astype("<u2")


def signatures(docs: DataFrame) -> DataFrame:
    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digests, sigs = [], [], []
        for text in texts_as_bytes(batch.column(1)):
            shingles = shingle_set(text)
            n.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            sigs.append(superminhash(shingles).tobytes() if len(shingles) else None)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "sig"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), sign, SIGNED)


def agreement(a: list[bytes], b: list[bytes]) -> np.ndarray:
    if not a:
        return np.empty(0, np.int64)
    x, y = (np.frombuffer(b"".join(s), dtype="<u2").reshape(len(s), -1) for s in (a, b))
    return (x == y).sum(axis=1)


def likely(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signatures agree enough, as (a, b, agree)."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = agreement(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["a", "b", "agree"])
        return out.filter(pa.array(n >= LEAST_AGREE))

    return map_batches(pairs.select("a", "b", "sig_a", "sig_b"), keep, "a long, b long, agree long", 8192)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, kept = (None, None), []
        for x, y in zip(texts_as_bytes(batch.column(2)), texts_as_bytes(batch.column(3)), strict=True):
            if last[0] != y:  # rows of one pivot come together
                last = y, shingle_set(y)
            other, mine = last[1], shingle_set(x)
            kept.append(similar(mine, other))
        return batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    # A frequent pivot's text is copied, so that its pairs are dealt to as many tasks.
    pairs = materialize(pairs.select("a", "b"), "near-pairs")
    least_hot = max(PIVOT_PAIRS, -(-pairs.count() // HOT_PIVOTS))
    hot = pairs.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > least_hot)
    hot = F.broadcast(hot.select("b", F.ceil(F.col("n") / PIVOT_PAIRS).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    a = texts.toDF("a", "text_a")
    b = texts.toDF("b", "text_b").join(hot, "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    pairs = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), copies).cast("int").alias("copy"))
    return map_batches(pairs.join(a, "a").join(b, ["b", "copy"]).select("a", "b", "text_a", "text_b"), keep, "a long, b long")


def sizes_allow(n: str, m: str) -> str:
    """The smaller set must be at least so large a part of the larger one."""
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def in_blocks(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components.

    rows has (key, i, j, own, band, node, n_shingles, root, sig, text), dealt and sorted
    by (key, i, j); a block with i < j compares rows of its own part i with those of
    part j only. A pair whose signatures agree enough is looked at in the first band
    that both share. With texts, it is verified here on the full sets, and only links
    that join two components of the block come out; without, the pair comes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple | None = None
        held: list[tuple] = []

        def pairs() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            out: list[tuple[int, int]] = []
            band, across = held[0][1], block[1] != block[2]
            own, node, n, root = (np.array([r[k] for r in held], dtype=np.int64) for k in (0, 2, 3, 4))
            joined = b"".join(r[5] for r in held)
            sigs = np.frombuffer(joined, dtype="<u2").reshape(len(held), -1)
            bands = np.frombuffer(joined, dtype="<u8").reshape(len(held), -1)
            sets: dict[int, np.ndarray] = {}

            def set_of(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingle_set(held[k][6])
                return sets[k]

            for x in range(len(held) - 1):
                small, large = np.minimum(n[x + 1 :], n[x]), np.maximum(n[x + 1 :], n[x])
                meet = (root[x + 1 :] != root[x]) & (100 * small >= PERCENT * large)
                if across:
                    meet &= own[x + 1 :] != own[x]
                others = x + 1 + np.flatnonzero(meet)
                if not len(others):
                    continue
                agree = (sigs[others] == sigs[x]).sum(axis=1) >= LEAST_AGREE
                others = others[agree & ((bands[others] == bands[x]).argmax(axis=1) == band)]
                for y in others.tolist():
                    if held[x][6] is not None:
                        if root[x] == root[y] or not similar(set_of(x), set_of(y)):
                            continue
                        root[root == root[y]] = root[x]
                    out.append((int(node[x]), int(node[y])))
            return out

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_BATCH):
                part, found = batch.slice(at, TEXT_BATCH), []
                columns = [c.to_pylist() for c in part.columns[:-1]]
                texts = [None] * part.num_rows if part.column(9).null_count == part.num_rows else texts_as_bytes(part.column(9))
                for row in zip(*columns, texts, strict=True):
                    if row[:3] != block:
                        found += pairs()
                        block, held = row[:3], []
                    held.append(row[3:])
                yield batch_of(found)
        yield batch_of(pairs())

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, "a long, b long")


def open_keys(rooted: DataFrame) -> DataFrame:
    """The buckets that hold several components."""
    return rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")


def links(nodes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """Enough verified links (a, b) between nodes (node, n_shingles, sig) to join all that belong together.

    repeated: whether a doc_id of docs stands on several rows.
    """
    key_of = lambda b: F.xxhash64(F.lit(b), F.substring("sig", 8 * b + 1, 8))
    keys = [F.struct(F.lit(b).alias("band"), key_of(b).alias("key")) for b in range(BANDS)]
    bands = nodes.select("node", F.explode(F.array(*keys)).alias("x")).select("node", "x.band", "x.key")
    pivot = F.min_by("node", F.xxhash64("node", "key")).alias("pivot")
    buckets = bands.groupBy("key").agg(F.count("*").alias("m"), pivot).filter("m > 1")
    members = materialize(bands.join(buckets, "key"), "near-members")
    involved = members.select(F.col("node").alias("doc_id")).distinct()
    # Most documents share no bucket: their texts are left out before the shuffle.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = split_marked(texts, "doc_id", marks(involved, "doc_id"))[1].join(involved, "doc_id", "left_semi")
    if repeated:  # else rows that repeat a text would be compared each
        texts = texts.groupBy("doc_id", F.xxhash64("text").alias("version")).agg(F.first("text").alias("text")).drop("version")
    texts = materialize(texts, "near-texts")

    a, b = nodes.toDF("a", "n_a", "sig_a"), nodes.toDF("b", "n_b", "sig_b")
    possible = lambda pairs: likely(pairs.join(a, "a").join(b, "b").filter(sizes_allow("n_a", "n_b")))
    surest = F.max_by("b", F.struct("agree", -F.col("b"))).alias("b")
    stars = members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    found = materialize(verified(possible(stars).groupBy("a").agg(surest), texts), "near-links")
    n_members = members.count()

    def rooted() -> tuple[DataFrame, DataFrame]:
        """(key, band, node, m, root) of the members, and (node, root) of those that are joined to others."""
        root = components(found)
        each = members.join(root, "node", "left").select("key", "band", "node", "m", F.coalesce("root", "node").alias("root"))
        return materialize(each, "near-rooted", n_members), root

    rows, root = rooted()
    before = None
    for turn in range(1, 1 + TURNS):
        large = materialize(rows.filter(F.col("m") > DENSE).join(open_keys(rows), "key"), "near-large", n_members)
        n = large.count()
        if not n or (before is not None and n > (1 - JOINED) * before):
            break
        before = n
        drawn = F.min_by(F.struct("node", "root"), F.xxhash64("node", "key", F.lit(turn))).alias("p")
        pairs = large.join(large.groupBy("key").agg(drawn), "key").filter("root <> p.root")
        pairs = pairs.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()
        of_root = possible(pairs).join(root.toDF("b", "b_root"), "b", "left").groupBy("a", F.coalesce("b_root", "b").alias("to"))
        more = materialize(verified(of_root.agg(surest), texts), "near-links")
        if more.isEmpty():
            break
        found = found.unionByName(more)
        rows, root = rooted()

    columns = ["key", "i", "j", "own", "band", "node", "n_shingles", "root", "sig", "text"]
    open_rows = rows.join(open_keys(rows), "key").join(nodes, "node")
    dealt = lambda df: df.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    zero = {c: F.lit(0) for c in ("i", "j", "own")}
    sparse = open_rows.filter(F.col("m") <= DENSE).withColumns(zero | {"text": F.lit(None).cast("string")})
    rest = verified(in_blocks(dealt(sparse)), texts)
    # Texts are joined once a member; only then is a member dealt to the blocks that it meets.
    dense = materialize(open_rows.filter(F.col("m") > DENSE), "near-dense")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
    dense = (
        dense.join(dense.groupBy("key").agg(parts), "key")
        .join(texts.withColumnRenamed("doc_id", "node"), "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    )
    return found.unionByName(rest).unionByName(in_blocks(dealt(dense)))


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have an empty set and are linked with nothing. Rows of
    one doc_id count as one document that has the links of each of its texts;
    they all stay or go. Texts whose rows all have a null doc_id form no
    component (component_id null) and stay. Very long texts are taken whole; the
    blocks that hold several are bounded by their shingles. An empty table gives an
    empty result.
    """
    signed = materialize(signatures(docs), "near-signatures")
    # Equal sets have equal signatures, so any of them will do.
    of_class = [F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")]
    classes = materialize(signed.filter("digest is not null").groupBy("digest").agg(*of_class), "near-classes")
    nodes = classes.filter("node is not null").select("node", "n_shingles", "sig")
    # A doc_id that stands on several rows ties their classes together.
    several = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    several = materialize(several, "near-several")
    found = links(nodes, docs, not several.isEmpty())
    named = signed.filter("digest is not null and doc_id is not null").select("doc_id", "digest")
    own = named.join(several, "doc_id").join(classes.select("digest", "node"), "digest")
    ties = own.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components(found.unionByName(ties))
    rooted = classes.select("digest", "node").join(roots, "node", "left")
    rooted = rooted.select("digest", F.coalesce("root", "node").alias("component_id"))
    whole = signed.select("doc_id", "n_shingles", "digest").join(rooted, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("component_id").isNull()
    return whole.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", kept)
