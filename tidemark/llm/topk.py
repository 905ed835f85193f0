"""Exact top-k search by a three-phase uniform threshold.

Queries and candidates meet in blocks of bounded size. The components are cut
into m slices; each slice of a block is a list of partial scores.

1. Each block gives, for each query, its local list: of the rows that lead the
   slice in which the block's vectors are longest, the best exact totals. The k-th
   best of all lists is a score that k rows reach, so it is a safe cutoff. This
   multiplies one slice only.
2. The cutoff is broadcast to every block. A row can reach it only if one of its m
   slices has at least the m-th part; those entries are collected.
3. Their scores are resolved exactly, and those that reach the cutoff, k of a block
   at most, go to the final ranking.

A block holds all slices of its rows, so the second and third phase run in one
task: partial scores of a quarter of all pairs would else be shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 64
SLICES = 4
#: Rows that lead a block's slice whose totals are resolved in the first phase, as a multiple of k.
LEADERS = 4
#: Queries whose leaders are resolved at a time.
RESOLVED = 64
#: Cutoffs that are broadcast, at most, of 16 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
QUERY_BLOCK = 1024
ROW_BLOCK = 4096
#: Components in a block of rows, at most, so that long vectors come in smaller blocks.
BLOCK_CELLS = 1 << 19
#: Sums of products below this are exact in doubles.
EXACT = float(2**53)
LONG = (-(2**63), 2**63 - 1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one vector for each vec_id, the least of several; no nulls, no non-finite components."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("v"))


def one_array(column: pa.ChunkedArray) -> pa.ListArray:
    out = column.combine_chunks()
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def matrix(flat: pa.ListArray, dims: int) -> np.ndarray:
    """Quantised rows, filled with zeros up to dims components."""
    lengths = np.diff(flat.offsets.to_numpy())
    values = np.floor(SCALE * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(lengths) and (lengths == dims).all():
        return values.reshape(-1, dims)
    out, at = np.zeros((len(lengths), dims)), 0
    for i, n in enumerate(lengths):
        out[i, :n] = values[at : at + n]
        at += n
    return out


def quantised(queries: pa.ChunkedArray, rows: pa.ChunkedArray, slices: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Matrices whose products are exact, and the bounds of the slices."""
    vectors = [one_array(queries), one_array(rows)]
    dims = max(1, *(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in vectors))
    q, x = (matrix(c, dims) for c in vectors)
    if dims * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) >= EXACT:
        q, x = (np.vectorize(int, otypes=[object])(m) for m in (q, x))
    edges = np.linspace(0, dims, min(slices, dims) + 1).astype(int).tolist()
    return q, x, list(zip(edges[:-1], edges[1:], strict=True))


def leaders(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    if scores.dtype == object:
        return np.argsort(-scores, axis=1)[:, :k]
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def as_long(x) -> int:
    return min(max(int(x), LONG[0]), LONG[1])


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query by integer inner product.

    Queries are the rows whose vec_id is divisible by `every`. vectors has vec_id and
    embedding; other columns are ignored. Components are floor(64 * x). Ties go to the
    smaller vec_id. Null vec_ids, null vectors and vectors with null or non-finite
    components take no part; of rows that repeat a vec_id the least vector does, as one row. Shorter vectors are filled with zeros. Scores
    beyond a long are set to its ends. An empty table gives an empty result.
    """
    rows = materialize(usable(vectors), "topk-rows")
    n, n_queries, dims = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
    most = max(64, BLOCK_CELLS // max(1, dims or 1))
    row_blocks, query_blocks = max(1, -(-n // min(ROW_BLOCK, most))), max(1, -(-n_queries // min(QUERY_BLOCK, most)))
    dealt = lambda blocks, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")
    to_all = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("qb", dealt(query_blocks, 1))
    found = rows.withColumn("rb", dealt(row_blocks, 2)).withColumn("qb", to_all(query_blocks))
    found = found.select("qb", "rb", F.col("vec_id").alias("row_id"), F.col("v").alias("row"))

    def met(asked: DataFrame, f, schema: str) -> DataFrame:
        each = asked.withColumn("rb", to_all(row_blocks))
        return each.groupBy("qb", "rb").cogroup(found.groupBy("qb", "rb")).applyInArrow(f, schema)

    def of_lists(asked, blocks, best) -> pa.Table:
        kinds = {"query_id": pa.int64(), "rb": pa.int32(), "best": pa.list_(pa.int64())}
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), (asked, blocks, best), strict=True)})

    def local_lists(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            return of_lists([], [], [])
        asked, ids = q.column("vec_id").to_numpy(), x.column("row_id").to_numpy()
        a, b, cut = quantised(q.column("v"), x.column("row"), slices)
        low, high = max(cut, key=lambda s: np.abs(a[:, s[0] : s[1]]).sum() * np.abs(b[:, s[0] : s[1]]).sum())
        # One more, as the query itself may lead.
        seen = leaders(a[:, low:high] @ b[:, low:high].T, LEADERS * k + 1)
        best = []
        for at in range(0, len(asked), RESOLVED):
            here = seen[at : at + RESOLVED]
            totals = (a[at : at + RESOLVED, None, :] * b[here]).sum(axis=2)
            for i, (columns, scores) in enumerate(zip(here, totals, strict=True), start=at):
                best.append(sorted(map(as_long, scores[ids[columns] != asked[i]]), reverse=True)[:k])
        return of_lists(asked, np.full(len(q), x.column("rb")[0].as_py()), best)

    def sufficient(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(q) and len(x):
            asked, cutoffs, ids = q.column("vec_id").to_numpy(), q.column("cutoff").to_pylist(), x.column("row_id").to_numpy()
            a, b, cut = quantised(q.column("v"), x.column("row"), slices)
            total = most = None
            for low, high in cut:
                part = a[:, low:high] @ b[:, low:high].T
                total = part if total is None else total + part
                most = part if most is None else np.maximum(most, part)
            for i, (query, least) in enumerate(zip(asked, cutoffs, strict=True)):
                enough = ids != query
                if least is not None:
                    enough &= np.asarray(most[i] * len(cut) >= least, dtype=bool)
                at = np.flatnonzero(enough)
                score = total[i, at]
                if least is not None:
                    reach = np.asarray(score >= least, dtype=bool)
                    at, score = at[reach], score[reach]
                falling = np.array([-as_long(s) for s in score], dtype=object if score.dtype == object else np.int64)
                for j in np.lexsort((ids[at], falling))[:k]:
                    for column, value in zip(out, (query, ids[at[j]], as_long(score[j])), strict=True):
                        column.append(int(value))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    lists = met(queries, local_lists, "query_id long, rb int, best array<long>")
    best_of = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=False), 1, k)
    # In two steps, so that no query gathers the lists of all blocks at once.
    some = lists.groupBy("query_id", (F.col("rb") % max(1, int(row_blocks**0.5))).alias("part")).agg(best_of("best").alias("best"))
    whole = some.groupBy("query_id").agg(best_of("best").alias("best"))
    cutoffs = whole.select(F.col("query_id").alias("vec_id"), F.get("best", F.lit(k - 1)).alias("cutoff"))
    cutoffs = materialize(cutoffs, "topk-cutoffs")
    asked = queries.join(F.broadcast(cutoffs) if n_queries <= BROADCAST_ROWS else cutoffs, "vec_id", "left")
    entries = met(asked, sufficient, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
