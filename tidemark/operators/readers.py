"""Pluggable readers: decomposition of items and reading of regions, item by item.

What a reader does is its own matter; this gives it blind input, keeps one item's
failure from others and turns it into a row that says which layer failed. A hang
is ended by a time limit in a process of its own, as Spark retries tasks, not rows.
"""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches
from .verdict import assert_blind

REGIONS = "array<struct<space:string,role:string,x:int,y:int,w:int,h:int>>"
READINGS = "item_id long, element string, executed boolean, column_resolved boolean, region_found boolean, readable boolean, value string, source string, error string"


#: Time that a reader has for one element, unless told otherwise.
SECONDS = 60.0
#: Items that share a process, at most.
ITEMS = 64


class Reader(Protocol):
    """Reads one element of an item; raises if it can't run at all."""

    def __call__(self, content: bytes, column_key: str, element: str) -> tuple[bool, bool | None, str | None]:
        """(region found, readable, value)"""


def _child(reader: Reader, items: list[list[tuple]], out) -> None:
    for calls in items:
        fine = True
        for args in calls:
            try:
                out.send((reader(*args), None))
            except BaseException as e:
                fine = False
                out.send((None, type(e).__name__))
        if not fine:
            return


def isolated(reader: Reader, calls: list[tuple], seconds: float | None = SECONDS) -> list[tuple[tuple | None, str | None]]:
    """For each call the reader's answer and no error, or no answer and the error's name.

    The calls of one item share a process. One that takes longer than `seconds` is a
    `timeout` and one that kills the process is `died`; the calls after it get a new
    process. Without a limit the reader runs in the task itself.
    """
    return isolated_items(reader, [calls], seconds)[0][0]


def isolated_items(reader: Reader, items: list[list[tuple]], seconds: float | None = SECONDS) -> list[tuple[list[tuple[tuple | None, str | None]], bool]]:
    """For each item, given as its calls, what isolated() gives, and whether items before it had used its process.

    Starting a process takes far longer than most readings, so items share one as long
    as they go well: one with a failure is the last of its process.
    """
    answers: list[list[tuple[tuple | None, str | None]]] = [[] for _ in items]
    shared = [False] * len(items)
    if seconds is None:
        for out, calls in zip(answers, items, strict=True):
            for args in calls:
                try:
                    out.append((reader(*args), None))
                except Exception as e:
                    out.append((None, type(e).__name__))
        return list(zip(answers, shared, strict=True))
    at = 0
    while at < len(items):
        out = answers[at]
        if len(out) == len(items[at]):
            at += 1
            continue
        # What is left of an item after a time-out or a death has a process of its own.
        left = [items[at][len(out) :]] if out else items[at:]
        here, there = multiprocessing.get_context("fork").Pipe(duplex=False)
        p = multiprocessing.get_context("fork").Process(target=_child, args=(reader, left, there), daemon=True)
        p.start()
        there.close()
        try:
            for k in range(len(left)):
                out, shared[at] = answers[at], shared[at] or k > 0
                while len(out) < len(items[at]):
                    if not here.poll(seconds):
                        out.append((None, "timeout"))
                        break
                    out.append(here.recv())
                if any(error is not None for _, error in out):
                    break
                at += 1
        except EOFError:
            out.append((None, "died"))
        finally:
            p.kill()
            p.join()
            here.close()
    return list(zip(answers, shared, strict=True))


def read_elements(items: DataFrame, reader: Reader | None, elements: tuple[str, ...], seconds: float | None = SECONDS, retries: int = 1, tasks: int | None = None) -> DataFrame:
    """Evidence for each item (item_id, content, column_key) and element.

    Items must be blind. An item whose column_key is null isn't read. Without a reader
    (degraded mode) nothing is executed, so verdicts go to review. What fails is
    tried again, alone in a new process, `retries` times, and once at least if the
    item's process had read others before. With `tasks` the items are dealt to so many
    tasks first, for readers that take longer than moving an item does.
    """
    assert_blind(items)

    def answers(content: bytes, key: str, first: list[tuple], shared: bool) -> list[tuple[tuple | None, str | None]]:
        found = list(first)
        for _ in range(max(retries, int(shared))):
            if not (failed := [i for i, (_, error) in enumerate(found) if error is not None]):
                break
            for i in failed:
                found[i] = isolated(reader, [(content, key, elements[i])], seconds)[0]
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), ITEMS):
                part = pdf.iloc[at : at + ITEMS]
                asked = list(zip(part["item_id"], part["content"], part["column_key"], strict=True))
                known = [(c, k) for _, c, k in asked if isinstance(k, str)] if reader is not None else []
                read = iter(isolated_items(reader, [[(c, k, e) for e in elements] for c, k in known], seconds))
                for item, content, key in asked:
                    if reader is None:
                        found = [(None, "no reader")] * len(elements)
                    elif not isinstance(key, str):
                        found = [(None, None)] * len(elements)
                    else:
                        found = answers(content, key, *next(read))
                    for element, (answer, error) in zip(elements, found, strict=True):
                        located, readable, value = answer or (None, None, None)
                        rows.append((item, element, reader is not None and error is None, isinstance(key, str), located, readable, value, f"reader:{element}", error))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in READINGS.split(", ")])

    bounded_batches(items.sparkSession)
    asked = items.select("item_id", "content", "column_key")
    return (asked if tasks is None else asked.repartition(tasks)).mapInPandas(run, READINGS)


def decompose(items: DataFrame, splitter: Callable[[bytes], list[tuple]]) -> DataFrame:
    """(item_id, space, role, x, y, w, h, error): a row for each region that the splitter finds, or one with its error."""
    assert_blind(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, content in zip(pdf["item_id"], pdf["content"], strict=True):
                try:
                    rows += [(item, *r, None) for r in splitter(content)]
                except Exception as e:
                    rows.append((item, None, None, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["item_id", "space", "role", "x", "y", "w", "h", "error"]).astype(dict.fromkeys("xywh", "Int32"))

    bounded_batches(items.sparkSession)
    return items.select("item_id", "content").mapInPandas(run, "item_id long, space string, role string, x int, y int, w int, h int, error string")


def align(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Where each registered control is now: the seen region of the same space and role whose corner is nearest to the registered one.

    expected (column_key, space, role, x, y), seen (item_id, column_key, space, role, x, y, w, h); a control without a seen region is left out.
    """
    want = expected.select("column_key", "space", "role", F.col("x").alias("map_x"), F.col("y").alias("map_y"))
    far = F.pow(F.col("x") - F.col("map_x"), 2) + F.pow(F.col("y") - F.col("map_y"), 2)
    place = F.struct("x", "y", "w", "h")
    return seen.join(want, ["column_key", "space", "role"]).groupBy("item_id", "column_key", "space", "role").agg(F.min_by(place, F.struct(far, place)).alias("at")).select("item_id", "column_key", "space", "role", "at.*")
