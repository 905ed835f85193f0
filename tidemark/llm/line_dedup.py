"""Line deduplication over overlapping three-line windows.

Windows are taken over the lines that have a word; each is keyed by a 128-bit
hash and the place (doc_id, text, position). A window that its own text has
already had is known at once. Of the others a first aggregation, combined on the
map side, finds those that several texts have, and the least doc_id of each, so a
window that stands in a third of all documents costs one row a task. Occurrences
of frequent windows are found by a broadcast of those windows, of which there can
be only HOT_WINDOWS, and the rest by a join. The covered line ranges of a document
are merged and taken out of its text. Of the texts only those are shuffled that
may lose lines, by a bitmap of bounded size.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, marks, materialize, split_marked, texts_as_bytes

LINES = 3
#: Windows that are joined by a broadcast, at most: only so many can each have a HOT_WINDOWS-th part of all places.
HOT_WINDOWS = 10_000
#: Places up to which a window is never among them.
LEAST_HOT = 1_000
_WINDOWS = "id long, version long, start int, stop int, h1 long, h2 long, again boolean"


def line_windows(lines: list[bytes], size: int = LINES, short_texts: bool = False) -> list[tuple[int, int, bytes]]:
    """(first line, last line, key) of each window.

    Lines without a word count for no window and lie within one that spans them.
    A text with fewer lines than a window has none, or with short_texts one of all of them.
    """
    counted = [(i, line) for i, line in enumerate(lines) if not line.isspace() and line]
    k = min(size, len(counted)) if short_texts else size
    if not counted or len(counted) < k:
        return []
    return [
        (counted[j][0], counted[j + k - 1][0], xxhash.xxh3_128_digest(b"\n".join(x for _, x in counted[j : j + k])))
        for j in range(len(counted) - k + 1)
    ]


def without(lines: list[bytes], ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The lines outside of all ranges, joined again, and how many were taken out."""
    kept, at = [], 0
    for start, stop in sorted(ranges):
        if start > at:
            kept += lines[at:start]
        at = max(at, stop + 1)
    kept += lines[at:]
    return b"\n".join(kept), len(lines) - len(kept)


def line_dedup(
    docs: DataFrame, size: int = LINES, short_texts: bool = False, counts: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """docs with text deduplicated, and with two counts added: lines, and lines taken out (replaced, if docs has such columns).

    The first occurrence of a window, by doc_id (null first), then a hash of the
    text, then position, stays; lines covered by later occurrences go. A text of
    fewer than `size` lines with a word has no window and stays as it is; with
    short_texts all of its lines are its window. Null texts stay null, with no lines.
    Rows that repeat both doc_id and text count as one place, so they get the same
    text. Very long texts and lines are taken whole. Extra columns go through; an
    empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in counts]
    # Internal names that no column of docs has.
    tag = "_" * (1 + max((len(c) for c in names), default=0))
    id_, version, covered = f"id{tag}", f"version{tag}", f"covered{tag}"
    least_id = F.lit(-(2**63))
    placed = docs.select(*[f"`{c}`" for c in names]).withColumns(
        {id_: F.coalesce(F.col("doc_id").cast("long"), least_id), version: F.xxhash64("text")}
    )

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for i, v, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_as_bytes(batch.column(2)), strict=True):
            had: set[bytes] = set()
            for start, stop, key in line_windows(text.split(b"\n"), size, short_texts):
                halves = (int.from_bytes(key[k : k + 8], "little", signed=True) for k in (0, 8))
                for column, value in zip(out, (i, v, start, stop, *halves, key in had), strict=True):
                    column.append(value)
                had.add(key)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _WINDOWS.split(", ")])

    places = materialize(map_batches(placed.select(id_, version, "text"), windows, _WINDOWS), "line-windows")
    window, place = ["h1", "h2"], ["id", "version", "start", "stop"]
    of_text = places.filter("not again").drop("again")
    firsts = of_text.groupBy(*window).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")
    firsts = materialize(firsts, "line-firsts")
    least_hot = max(LEAST_HOT, -(-of_text.count() // HOT_WINDOWS))
    hot = F.broadcast(firsts.filter(F.col("n") > least_hot).drop("n"))
    other = firsts.filter(F.col("n") <= least_hot).drop("n")
    marked = of_text.join(hot, window, "left")
    repeated = marked.filter("first_id is not null").unionByName(marked.filter("first_id is null").drop("first_id").join(other, window))
    repeated = materialize(repeated, "line-repeated")
    # In the first document a window can stand in several texts, where a doc_id (or null) has several.
    own = repeated.filter("id = first_id")
    texts = own.groupBy(*window).agg(F.min("version").alias("least"), F.max("version").alias("most")).filter("least <> most")
    later = repeated.filter("id > first_id").select(*place)
    in_same = own.join(texts, window).filter("version > least").select(*place)
    both = places.filter("again").select(*place).unionByName(later).unionByName(in_same)
    ranges = both.groupBy("id", "version").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    ranges = materialize(ranges.toDF(id_, version, covered), "line-ranges")
    # Documents that lose nothing are most: they go on as they are, and only the others' texts are shuffled.
    whole, rest = split_marked(placed, id_, marks(ranges, id_))
    nothing = F.lit(None).cast(ranges.schema[covered].dataType)
    found = whole.withColumn(covered, nothing).unionByName(rest.join(ranges, [id_, version], "left"))

    def take_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, before, removed = [], [], []
        for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column(covered).to_pylist(), strict=True):
            lines = text.split(b"\n") if text else []
            rest, n = without(lines, [(x["start"], x["stop"]) for x in found]) if found else (text, 0)
            texts.append(rest)
            before.append(len(lines))
            removed.append(n)
        own = {"text": pa.array(texts, pa.binary()).cast(pa.string())}
        columns = [own.get(c, batch.column(c)) for c in names]
        counted = [pa.array(before, pa.int64()), pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *counted], names=[*names, *counts])

    kept_as = [f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name in names]
    schema = ", ".join([*kept_as, *(f"`{c}` long" for c in counts)])
    return map_batches(found, take_out, schema)
