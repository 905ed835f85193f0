"""Packing documents into fixed windows by best-fit decreasing.

A document's ids are cut into full windows and one shorter tail. Best-fit
decreasing needs only how many pieces there are of each length, and lengths are
at most the window, so the exact plan for a corpus of any size is made from a
histogram of at most `window` rows: pieces of one length that go to windows with
the same remaining room are placed as one run. A segment tree indexed by the
remaining room finds the tightest open windows. The plan has a few rows for each
length; the pieces find their place in it by their rank within their length,
which is counted in salted groups so that no length meets in one task.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, width

WINDOW = 2048
END_ID = 1
#: Rows of a plan that is broadcast, at most, of 48 bytes each.
BROADCAST_ROWS = 1_000_000
PROBES = ("It's 1,234 WORDS  here,\n\n\tI'LL say: été 中文 😀!?", "", " lead and trail ", "a<|endoftext|>b")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class RoomTree:
    """A segment tree over 0..size of the runs of open windows, by remaining room."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, room: int, value: bool) -> None:
        i = room + self.leaves
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """count windows from number first on have this room."""
        if room > 0 and count > 0:
            self.runs.setdefault(room, []).append((first, count))
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        runs = self.runs[room]
        out = runs.pop()
        if not runs:
            del self.runs[room]
            self._mark(room, False)
        return out

    def tightest(self, length: int) -> int | None:
        """The least room that is at least length."""
        i = length + self.leaves
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first_rank, count, per_window, first_window, offset).

    Pieces of one length with ranks first_rank.. go, per_window at a time, to
    consecutive windows from first_window on, beginning at offset. The result is
    that of placing the pieces one by one, longest first, each in the open window
    with the least room that holds it.
    """
    tree, plan, opened = RoomTree(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if (room := tree.tightest(length)) is None:
                room, fit = window, window // length
                first, have = opened, -(-left // fit)
                opened += have
            else:
                (first, have), fit = tree.take(room), room // length
            full = min(have, left // fit)
            if full:
                plan.append((length, rank, full * fit, fit, first, window - room))
                tree.add(room - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if have > full:
                used = min(left, fit)
                if used:
                    plan.append((length, rank, used, used, first + full, window - room))
                    tree.add(room - used * length, first + full, 1)
                    rank, left, full = rank + used, left - used, full + 1
                tree.add(room, first + full, have - full)
    return plan


@cache
def whole_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a tokenizers file must say for ranks alone to give its ids, and the words that such a file splits a text into.
PLAIN_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False,
}
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def check_plain(spec: dict) -> None:
    """Raise ValueError unless the file is byte-level BPE without any normalizer, whose merges come in the order of their ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k, v in PLAIN_MODEL.items() if model.get(k) not in ((v, "") if v is None else (v,))]
    odd += [k for k, v in PLAIN_SPLIT.items() if split.get(k) != v]
    odd += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if odd or merged != sorted(merged):
        raise ValueError(f"not by ranks: {odd or 'merges'}")


@cache
def ranked(path: str):
    """The ranks of a byte-level BPE file of the tokenizers library, applied by tiktoken; ValueError if the file asks for more."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    check_plain(spec)
    # Printable stand-ins of the 256 bytes in byte-level BPE files.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens=special)


def ranks_agree(path: str) -> bool:
    """Whether the file's settings are those that ranks alone follow, and the probes get the same ids; asked once, on the driver."""
    try:
        fast, slow = ranked(path), whole_tokenizer(path)
        return all(fast.encode(t, allowed_special="all") == slow.encode(t, add_special_tokens=False).ids for t in PROBES)
    except (KeyError, ValueError):
        return False


def encoder(path: str, by_ranks: bool = True) -> Callable[[str], np.ndarray]:
    """Ids of a text: by ranks, several times faster, or by tokenizers itself.

    A text that tiktoken can't take goes through tokenizers too, which a worker
    loads only then.
    """

    def slow(text: str) -> np.ndarray:
        return np.array(whole_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def fast(text: str) -> np.ndarray:
        try:
            return np.frombuffer(ranked(path).encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except BaseException as e:  # the library's own panics derive from BaseException
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return slow(text)

    return fast if by_ranks else slow


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: full windows, then the rest."""
    by_ranks = ranks_agree(tokenizer)

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer, by_ranks)
        out: list[list] = [[] for _ in range(5)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
            for start in range(0, len(ids), window):
                part = ids[start : start + window]
                for column, value in zip(out, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in PIECES.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), pieces, PIECES)


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to pieces (at least doc_id, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(width(spark))).cast("int"))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "packing-counts")
    # At most `window` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit_decreasing(histogram, window)
    plan = spark.createDataFrame(runs, "plan_length long, first_rank long, run long, per_window long, first_window long, at long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        salted.withColumn("row", F.row_number().over(within) - 1)
        .join(offsets, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("row"))
    )
    nth = F.col("rank") - F.col("first_rank")
    # The plan has a few rows for each length, however many pieces there are; its rows are counted all the same.
    here = F.broadcast(plan) if len(runs) <= BROADCAST_ROWS else plan
    return (
        ranked.join(here, (F.col("length") == F.col("plan_length")) & (nth >= 0) & (nth < F.col("run")))
        .withColumn("sequence_id", F.expr("first_window + (rank - first_rank) div per_window"))
        .withColumn("offset", F.col("at") + nth % F.col("per_window") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack docs (doc_id, text; other columns are ignored) into sequences of at most `window` ids.

    Null and empty texts are documents of the end id alone. Repeated rows, and rows
    with a null doc_id, are packed each. Very long texts are encoded whole, one at a
    time. An empty table gives an empty result. Every sequence but the
    last of its kind is full or has no room for any shorter piece that remained;
    pieces of one sequence lie one behind the other from offset 0.
    """
    return place(materialize(cut(docs, tokenizer, window, end_id), "packing-pieces"), window)
