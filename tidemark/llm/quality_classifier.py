"""A quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear score of features of its whole text. The model
says that the better of two documents wins with the logistic probability of their
difference in score, and is fitted by logistic loss to all pairs of a labelled good
and a labelled bad document. A quantile of the strengths of the labelled rows is the
threshold; scores are mapped to 0..1 so that it lies at 0.7.

All labels teach, with all their pairs, none of which is formed. What a pair adds to
the loss depends smoothly on two strengths alone, so a row is spread over nodes, NODES
to a unit of strength, with the weights of polynomials through TAPS of them (errors
of at most 5e-8 were measured). Sums at the nodes, of rows, features and their
products, give the loss, its gradient and its curvature. A step of Newton's method is
one pass over the features, which lie in blocks of about BLOCK rows. Sums are rounded
once for a block and added as integers, and so don't depend on how blocks are dealt
to tasks.

Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, marks, materialize, split_marked, texts_as_bytes

#: Pairs that the plain fit of the tests draws, and how; the fit here takes all pairs.
PAIRS = 200_000
SEED = 6
PENALTY = 1e-3
STEPS = 30
THRESHOLD = 0.7
#: Rows of features in a block, about, and blocks whose moments are merged in one task.
BLOCK = 512
MERGED = 1024
#: Nodes to a unit of strength, and nodes over which a row is spread.
NODES = 4
TAPS = 8
#: Parts into which a range of strengths is cut, again and again, in search of the threshold.
BINS = 1 << 14

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>=_{}[]\\^~@/+"))
NAMES = (
    "log_words", "log_chars", "word_length", "upper", "lower", "digit", "high", "space", "symbol", "other",
    "stop", "comma", "exclaim", "question", "quote", "bar", "hash", "star", "dollar", "percent", "ampersand",
    "angle", "distinct", "same_as_before", "repeated_pairs", "log_line_words", "repeated_lines", "ended_lines", "capital_words", "odd_words", "most_common",
)
#: Characters counted for each of the features from `stop` to `angle`.
_COUNTED = (b".", b",", b"!", b"?", b"\"'", b"|", b"#", b"*", b"$", b"%", b"&", b"<>")


def features(text: bytes) -> np.ndarray:
    """Shares and logarithms, all finite; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(NAMES))
    size = len(text)
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    solid = size - seen[_SPACE].sum()
    share = lambda mask: seen[mask].sum() / size
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    counts = np.bincount(ids)
    pairs = ids[:-1] * len(number) + ids[1:]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    first = np.array([w[0] for w in number])[ids]
    last = np.array([w[-1] for w in number])[ids]
    letter_end = _LOWER[last] | _UPPER[last] | _HIGH[last] | np.isin(last, list(b".,;:"))
    return np.array([
        np.log1p(n), np.log1p(size), solid / n, share(_UPPER), share(_LOWER), share(_DIGIT), share(_HIGH), share(_SPACE), share(_SYMBOL),
        1 - share(_UPPER | _LOWER | _DIGIT | _HIGH | _SPACE | _SYMBOL),
        *[sum(seen[b] for b in chars) / n for chars in _COUNTED],
        len(number) / n, (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0, 1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0.0,
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        _UPPER[first].mean(), 1 - letter_end.mean(), counts.max() / n,
    ])


_LEFT, _RIGHT = np.triu_indices(len(NAMES))


def spread(strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of TAPS nodes of each strength, and its weight at each of them."""
    at = strength * NODES
    first = np.floor(at).astype(np.int64) - (TAPS // 2 - 1)
    t, taps = at - first, np.arange(TAPS)
    weights = [np.prod([(t - i) / (j - i) for i in taps if i != j], axis=0) for j in taps]
    return first, np.stack(weights, axis=1)


class PairwiseRanker:
    """Weights of standardised features, the threshold and the scale of scores."""

    def __init__(self) -> None:
        d = len(NAMES)
        self.mean, self.scale, self.weights = np.zeros(d), np.ones(d), np.zeros(d)
        self.cut, self.slope = 0.0, 1.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def strength(self, x: np.ndarray) -> np.ndarray:
        # Not by BLAS, where a row's sum may depend on the rows beside it.
        return (self.standard(x) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raised = 2 * self.slope * (self.strength(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(raised, -500, 500)))

    def at_nodes(self, x: np.ndarray, number: np.ndarray) -> tuple[int, np.ndarray]:
        """The first node, and for each node from there the sums of 1, features and their products over so many of each row."""
        z = self.standard(x)
        first, weights = spread(self.strength(x))
        low = int(first.min())
        dealt = np.zeros((int(first.max()) - low + TAPS, len(x)))
        dealt[(first - low)[:, None] + np.arange(TAPS), np.arange(len(x))[:, None]] = weights * number[:, None]
        return low, dealt @ np.hstack([np.ones((len(x), 1)), z, z[:, _LEFT] * z[:, _RIGHT]])


def featured(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.array([features(t).tolist() for t in texts_as_bytes(batch.column(1))], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), rows], names=["key", "x"])

    return map_batches(docs.select("key", "text"), run, "key long, x array<double>")


def in_blocks(taught: DataFrame, n: int) -> DataFrame:
    """(block, good, bad, x): rows (x, good, bad) as arrays in bytes, of a block each, in order of x."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x = np.array(rows.column("x").to_pylist())
        order = np.lexsort(x.T[::-1])
        parts = [rows.column(c).to_numpy()[order] for c in ("good", "bad")]
        return pa.table({"block": rows.column("block")[:1], **{c: [p.tobytes()] for c, p in zip(("good", "bad", "x"), [*parts, x[order]], strict=True)}})

    block = F.pmod(F.xxhash64("x"), F.lit(max(1, -(-n // BLOCK))))
    blocks = taught.withColumn("block", block).groupBy("block").applyInArrow(pack, "block long, good binary, bad binary, x binary")
    # These rows are wide, and each pass over them is as parallel as they have files.
    return materialize(blocks, "quality-blocks", 8 * n)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block, good, bad, x = (batch.column(c)[i] for c in range(4))
            good, bad = (np.frombuffer(v.as_buffer(), np.int64) for v in (good, bad))
            yield block.as_py(), good, bad, np.frombuffer(x.as_buffer()).reshape(len(good), -1)


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (number, mean, sum of squared deviations, least, most), one column for each measure, as one."""
    total = parts[0]
    for p in parts[1:]:
        n, apart = total[0] + p[0], p[1] - total[1]
        squares = total[2] + p[2] + apart**2 * total[0] * p[0] / n
        total = np.array([n, total[1] + apart * p[0] / n, squares, np.minimum(total[3], p[3]), np.maximum(total[4], p[4])])
    return total


def moments(blocks: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """merged() of f of all rows of features; None without rows. Blocks are merged in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, good, bad, x in unpacked(batches):
            n, y = (good + bad)[:, None], f(x)
            mean = (y * n).sum(axis=0) / n.sum()
            of_block = np.array([np.full(len(mean), n.sum()), mean, ((y - mean) ** 2 * n).sum(axis=0), y.min(axis=0), y.max(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array([block // MERGED]), pa.array([block]), pa.array([of_block.tobytes()])], names=["part", "block", "found"])

    def in_order(rows: pa.Table) -> np.ndarray:
        return merged([np.frombuffer(r["found"]).reshape(5, -1) for r in rows.sort_by("block").to_pylist()])

    def merge(rows: pa.Table) -> pa.Table:
        return pa.table({"block": rows.column("part")[:1], "found": [in_order(rows).tobytes()]})

    found = blocks.mapInArrow(run, "part long, block long, found binary").groupBy("part").applyInArrow(merge, "block long, found binary").toArrow()
    return in_order(found) if found.num_rows else None


def node_sums(blocks: DataFrame, ranker: PairwiseRanker, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order, and for each the sums of at_nodes() over the good rows and the bad; n is the number of all."""
    unit = 2.0 ** (56 - n.bit_length())  # no product of two features exceeds 25, so all sums fit into 63 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, good, bad, x in unpacked(batches):
            for side, number in enumerate((good, bad)):
                if number.any():
                    low, found = ranker.at_nodes(x[number > 0], number[number > 0])
                    for node, row in enumerate(np.rint(found * unit).astype(np.int64), low):
                        if node not in sums:
                            sums[node] = np.zeros((2, found.shape[1]), np.int64)
                        sums[node][side] += row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["node", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in rows.column("sums"))
        return pa.table({"node": rows.column("node")[:1], "sums": [total.tobytes()]})

    found = blocks.mapInArrow(run, "node long, sums binary").groupBy("node").applyInArrow(add, "node long, sums binary").toArrow().sort_by("node")
    return found.column("node").to_numpy(), np.array([np.frombuffer(v.as_buffer(), np.int64).reshape(2, -1) for v in found.column("sums")]) / unit


def loss_of_pairs(nodes: np.ndarray, sums: np.ndarray, pairs: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean logistic loss over all pairs of a good row and a bad one, its gradient and its curvature."""
    d = len(NAMES)
    good, bad = sums[:, 0] / np.sqrt(pairs), sums[:, 1] / np.sqrt(pairs)
    loss, gradient, crossed, products = 0.0, np.zeros(d), np.zeros((d, d)), np.zeros(len(_LEFT))
    for i in range(0, len(nodes), 256):
        some = good[i : i + 256]
        apart = np.clip((nodes[i : i + 256, None] - nodes[None, :]) / NODES, -500, 500)
        lost = 1 / (1 + np.exp(apart))
        curve = lost * (1 - lost)
        loss += some[:, 0] @ np.logaddexp(0, -apart) @ bad[:, 0]
        gradient += (lost.T @ some[:, 0]) @ bad[:, 1 : d + 1] - (lost @ bad[:, 0]) @ some[:, 1 : d + 1]
        crossed += some[:, 1 : d + 1].T @ curve @ bad[:, 1 : d + 1]
        products += (curve @ bad[:, 0]) @ some[:, d + 1 :] + (curve.T @ some[:, 0]) @ bad[:, d + 1 :]
    own = np.zeros((d, d))
    own[_LEFT, _RIGHT] = own[_RIGHT, _LEFT] = products
    return float(loss), gradient, own - crossed - crossed.T


def middle(blocks: DataFrame, ranker: PairwiseRanker, low: float, high: float, k: int) -> float:
    """Between the k-th least strength and the next, of all from low to high."""
    while low < high:

        def run(batches: Iterator[pa.RecordBatch], low: float = low, high: float = high) -> Iterator[pa.RecordBatch]:
            for _, good, bad, x in unpacked(batches):
                s = ranker.strength(x)
                inside = (s >= low) & (s <= high)
                s, n = s[inside], (good + bad)[inside]
                at = np.minimum((s - low) / (high - low) * BINS, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), pa.array(s)], names=["bin", "n", "s"])

        parts = blocks.mapInArrow(run, "bin long, n long, s double").groupBy("bin").agg(F.sum("n"), F.min("s"), F.max("s")).collect()
        parts.sort()
        i = 0
        while k > parts[i][1]:
            k -= parts[i][1]
            i += 1
        if k == parts[i][1]:
            return (parts[i][3] + parts[i + 1][2]) / 2
        low, high = parts[i][2], parts[i][3]
    return low


def fitted(blocks: DataFrame) -> PairwiseRanker:
    """The ranker that all rows of the blocks teach; without rows of both kinds, one that scores THRESHOLD."""
    ranker, d = PairwiseRanker(), len(NAMES)
    of_x = moments(blocks, lambda x: x)
    if of_x is None:
        return ranker
    n = int(of_x[0][0])
    deviation = np.sqrt(of_x[2] / n)
    ranker.mean, ranker.scale = of_x[1], np.where(deviation > 1e-9, deviation, 1.0)
    nodes, sums = node_sums(blocks, ranker, n)
    n_good, n_bad = (round(v) for v in sums[:, :, 0].sum(axis=0))
    if not n_good or not n_bad:
        return ranker
    least, before = np.inf, ranker.weights
    for _ in range(STEPS):  # Newton's method on the penalised logistic loss
        loss, gradient, curve = loss_of_pairs(nodes, sums, n_good * n_bad)
        loss += PENALTY / 2 * ranker.weights @ ranker.weights
        if loss > least + 1e-7:  # too far
            ranker.weights = (before + ranker.weights) / 2
        else:
            step = np.linalg.solve(curve + PENALTY * np.eye(d), gradient + PENALTY * ranker.weights)
            least, before, ranker.weights = loss, ranker.weights, ranker.weights - step
            if np.abs(step).max() < 1e-6:
                break
        nodes, sums = node_sums(blocks, ranker, n)
    else:
        ranker.weights = before  # the best so far
    strength = moments(blocks, lambda x: ranker.strength(x)[:, None])[:, 0]
    # As large a part of the labelled rows lies below the threshold as is labelled bad.
    cut = middle(blocks, ranker, strength[3], strength[4], n_bad)
    ranker.slope, ranker.cut = 1 / max(1e-9, float(np.sqrt(strength[2] / n))), float(cut)
    return ranker


def quality_scores(docs: DataFrame, labels: DataFrame, learn_from, max_fit: int | None = None) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs (doc_id, text; other columns are ignored).

    labels has doc_id and quality; rows other than 0 and 1, and rows that
    learn_from (a condition on doc_id) leaves out, teach nothing. All others teach,
    unless a caller asks for max_fit documents at most, those with the least hash.
    Of several labels of a document the least holds; of several rows with a label's
    doc_id the one with the least features teaches, so a repeated row changes no
    score. Null and empty texts are scored as texts with zero features, very long
    ones whole, one at a time.
    Rows with a null doc_id teach nothing and are scored. Without labels of both
    kinds every score is 0.7. An empty table gives an empty result.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.filter(F.col("quality").isin(0, 1) & learn_from(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").alias("key")).agg(F.min("quality").cast("long").alias("good"))
    if max_fit is not None:
        chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(max_fit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = materialize(chosen, "quality-labels")
    # Only features are shuffled, never texts: those of all rows whose doc_id may have a label.
    _, perhaps = split_marked(texts.withColumnRenamed("doc_id", "key"), "key", marks(chosen, "key"))
    matched = featured(perhaps).groupBy("key").agg(F.min("x").alias("x")).join(chosen, "key")
    # Rows with equal features are one row with their numbers, so copies fill no block, and ids don't order the fit.
    taught = matched.groupBy("x").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    ranker = fitted(in_blocks(taught, chosen.count()))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in texts_as_bytes(batch.column(1))]
        s = ranker.score(np.array(found).reshape(len(found), len(NAMES)))
        columns = [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return map_batches(texts, score, "doc_id long, score double, predicted int")
