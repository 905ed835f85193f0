"""File trees as tables.

Spark's own file source hides names that begin with a dot or an underscore, and
some of those are to be scanned. The tree is therefore listed by directory in
tasks: the driver opens only as many directories as give the tasks enough to do,
and holds no file names. Contents are read by the tasks, only for rows that are
left after all tests of their paths. A root is a path that all executors mount, or
a URI of a file system that pyarrow opens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import bounded_batches, tasks_of

#: Directories that the driver opens, about, and names of directories that it holds, at most.
DRIVER_DIRS = 256
MOST_DIRS = 100_000
#: Files in one batch of a listing.
LISTED = 10_000


def _local(root: str) -> str | None:
    """The path of a local root; None for other file systems."""
    if "://" not in root and not root.startswith("file:"):
        return root
    parts = urlsplit(root)
    return unquote(parts.path) if parts.scheme == "file" else None


def _below(root: str, rel: str) -> str:
    return f"{root.rstrip('/')}/{rel}" if rel else root


def _listed(root: str, rel: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, whether it is a directory) of what is directly in a directory."""
    here = _local(root)
    try:
        if here is not None:
            entries = os.scandir(os.path.join(here, rel))
        else:
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(root)
            found = system.get_file_info(fs.FileSelector(_below(base, rel)))
    except OSError:
        return
    if here is None:
        for x in found:
            yield (f"{rel}/{x.base_name}" if rel else x.base_name), x.size or 0, x.type == fs.FileType.Directory
        return
    with entries:
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                if e.is_dir(follow_symlinks=False):
                    yield path, 0, True
                elif e.is_file():
                    yield path, e.stat().st_size, False
            except OSError:
                continue


def _starts(root: str) -> list[tuple[str, bool]]:
    """(directory, whether all below it is to be listed too) of a task's rows."""
    opened: list[tuple[str, bool]] = []
    level = [""]
    while level and len(opened) + len(level) <= DRIVER_DIRS:
        below = []
        for d in level:
            for path, _, is_dir in _listed(root, d):
                if is_dir:
                    below.append(path)
                if len(below) > MOST_DIRS:
                    return opened + [(x, True) for x in level]
        opened += [(d, False) for d in level]
        level = below
    return opened + [(d, True) for d in level]


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel, size) of all regular files below root, hidden ones included; links that lead nowhere and links to directories are left out."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[str, int]] = []
        for pdf in batches:
            for top, deep in zip(pdf["dir"], pdf["deep"], strict=True):
                todo = [top]
                while todo:
                    for path, size, is_dir in _listed(root, todo.pop()):
                        if not is_dir:
                            rows.append((path, size))
                        elif deep:
                            todo.append(path)
                        if len(rows) >= LISTED:
                            yield pd.DataFrame(rows, columns=["rel", "size"])
                            rows = []
        yield pd.DataFrame(rows, columns=["rel", "size"]).astype({"size": "int64"})

    starts = _starts(root)
    tasks = max(1, min(len(starts), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(starts, "dir string, deep boolean").repartition(tasks).mapInPandas(walk, "rel string, size long")


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """files (rel, ...) with content added; null where a file can't be read.

    A directory is listed by one task, however many files it has, so files are dealt to tasks by their paths first.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                yield part.assign(content=[_content(root, rel) for rel in part["rel"]])

    bounded_batches(files.sparkSession)
    dealt = files.repartition(tasks_of(files.sparkSession), "rel")
    return dealt.mapInPandas(read, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def _content(root: str, rel: str) -> bytes | None:
    try:
        if (here := _local(root)) is not None:
            with open(os.path.join(here, rel), "rb") as f:
                return f.read()
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        with system.open_input_file(_below(base, rel)) as f:
            return f.read()
    except OSError:
        return None


def write_tree(files: DataFrame, root: str) -> int:
    """Write files (rel, content) below a local root that all executors mount, and count them; a task that runs twice writes the same."""
    here = _local(root)
    if here is None:
        raise ValueError(f"not a local path: {root}")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rel, content in zip(pdf["rel"], pdf["content"], strict=True):
                path = os.path.join(here, rel)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.{os.getpid()}", path)
            yield pdf[["rel"]]

    bounded_batches(files.sparkSession)
    return files.select("rel", "content").mapInPandas(write, "rel string").count()


def decoded(content: Column) -> Column:
    """Text of strictly valid UTF-8; null for anything else."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)
