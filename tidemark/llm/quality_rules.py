"""Quality rules by repetition coverage.

Each document is judged from its own text alone, so the plan is one scan with
no shuffle. Rolling hashes of several n-gram lengths run in numpy over the word
hashes of a document; the characters inside n-grams and lines that repeat an
earlier one are set against all characters. The first occurrence doesn't count,
so that a heading set again at the end costs its length once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_as_bytes

#: Largest share of characters inside n-grams seen before in the text, by n: the longer the n-gram, the less chance repeats it.
#: These and the next are the limits published with the Gopher corpus (Rae et al., 2021, table A1).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters inside repeated lines.
LINE_LIMIT = 0.20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = b"#*$%&|<>"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"
)


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def repeated_windows(keys: np.ndarray, with_first: bool) -> np.ndarray:
    """True where a window's key occurs twice or more; the first of them only if asked for."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = same
    if with_first:
        out[order[:-1]] |= same
    return out


def spread(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """True for each word inside a window of n words that begins where starts is true."""
    edge = np.zeros(words + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def exact_trigrams(ids: np.ndarray) -> np.ndarray:
    """One key for each 3-word window; equal keys exactly for equal windows."""
    distinct = int(ids.max()) + 1
    if distinct < 1 << 21:
        return (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
    return np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True)[1]


def measure(text: bytes, ngrams: Sequence[int]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, share of characters in repeated lines, shares in repeated n-grams."""
    words = text.split()
    n = len(words)
    n_symbols = sum(text.count(s) for s in SYMBOLS)
    if not n:
        return 0, 0, n_symbols, 0, 0, 0.0, dict.fromkeys(ngrams, 0.0)
    ids = word_ids(words)
    first = {w: len(w.decode("utf-8", "surrogatepass")) if not w.isascii() else len(w) for w in set(words)}
    chars = np.fromiter((first[w] for w in words), dtype=np.int64, count=n)
    total = int(chars.sum())

    seen: set[bytes] = set()
    dup_lines, dup_chars = 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.split())
        elif line.strip():
            seen.add(line)

    repeats, shares = 0, dict.fromkeys(ngrams, 0.0)
    if n >= 4:
        twice = repeated_windows(exact_trigrams(ids), with_first=True)
        repeats = int(spread(twice, 3, n).sum()) if twice.any() else 0
        # A longer n-gram can repeat only where its 3-word windows do.
        if repeats and ngrams:
            table = {w: xxhash.xxh3_64_intdigest(w) for w in first}
            hashes = np.fromiter((table[w] for w in words), dtype=np.uint64, count=n)
            rolled, length = hashes.copy(), 1
            for k in sorted(ngrams):
                while length < k and len(rolled) > 1:
                    rolled = rolled[:-1] * _MULTIPLIER + hashes[length:]
                    length += 1
                if length < k:
                    break
                twice = repeated_windows(rolled, with_first=False)
                if not twice.any():
                    break
                shares[k] = float(chars[spread(twice, k, n)].sum()) / total
    return n, total, n_symbols, dup_lines, repeats, dup_chars / total, shares


def verdict(text: bytes, limits: dict[int, float], line_limit: float) -> tuple:
    """The measures of a text, whether it fails the base rule, whether it is kept, and the largest shares."""
    n, chars, symbols, lines, repeats, line_share, shares = measure(text, tuple(limits))
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    kept = not failed and line_share <= line_limit and all(shares[k] <= limits[k] for k in limits)
    return n, chars, symbols, lines, repeats, failed, kept, line_share, max(shares.values(), default=0.0)


def quality_filter(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, in one scan."""
    limits = NGRAM_LIMITS if ngram_limits is None else ngram_limits
    at = docs.columns.index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([verdict(t, limits, line_limit)[6] for t in texts_as_bytes(batch.column(at))], pa.bool_()))

    return map_batches(docs, keep, docs.schema)


def quality_rules(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One verdict for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no words and fail the base rule. Repeated rows,
    and rows with a null doc_id, are judged each on its own. Very long texts are
    judged whole, one at a time. An empty table gives an empty result.
    """
    limits = NGRAM_LIMITS if ngram_limits is None else ngram_limits

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [verdict(t, limits, line_limit) for t in texts_as_bytes(batch.column(1))]
        columns = list(zip(*rows, strict=True)) or [()] * 9
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), judge, SCHEMA)
