"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import new_path

#: ASCII white space, the separators of a word in most operators.
SPACE = r"\x20\x09-\x0D"
#: Rows of whole texts that Python works on at a time.
TEXT_BATCH = 256
#: Bits of a bitmap of marked ids.
MARKS = 1 << 25
#: Narrow rows in one file of a table whose size is known.
FILE_ROWS = 200_000
#: Rows in one Arrow batch between the JVM and Python, at most.
ARROW_ROWS = 512


#: Tables written by this process that release() has not deleted.
_written: list[str] = []


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts the lineage like a checkpoint, but the files are columnar and
    compressed, and a lost executor takes none of them with it. rows, where it is
    known how many there can be, keeps small tables to few files.
    """
    spark = df.sparkSession
    path = new_path(spark, f"tables/{label}")
    _written.append(path)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    # Nobody else looks for the mark of a finished job.
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def so_far() -> int:
    """How many tables materialize() keeps; for release(since=...)."""
    return len(_written)


def release(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Delete all that materialize() keeps, but for what `keep` reads and what was there at `since`.

    Only once no other result that reads those tables is needed.
    """
    read = keep.inputFiles() if keep is not None else []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in _written[since:]:
        if not any(p.split("://")[-1] in f for f in read):
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
            _written.remove(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Groups into which hot keys are salted: as many as a shuffle has partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long: with Spark's default of 10,000 rows a batch takes tens of MB, in both processes of every task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def give_back() -> None:
    """Return free memory to the system at a task's end: workers are kept for later tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = TEXT_BATCH) -> DataFrame:
    """mapInArrow, with f given slices of at most so many rows, under the columns' own names."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield f(batch.slice(at, rows).rename_columns(names))
        finally:
            give_back()

    bounded_batches(df.sparkSession)
    # By number, as a column's name can have a dot.
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def marks(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap of MARKS bits over hashes of a column: (bucket, bits), at most 1024 rows of 4 KB for any number of ids."""
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(MARKS)) + 1
    known = ids.filter(F.col(column).isNotNull())
    found = known.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    # Dealt by bucket first: else each task would make and send bitmaps of its own.
    return found.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def split_marked(df: DataFrame, column: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose id surely isn't marked, and those whose id may be.

    The bitmap's size is bounded, so it is broadcast; the more ids are marked, the
    more rows may be, and only those need a join that shuffles them.
    """
    bucket, bits, at = (n + "_" * (1 + max(map(len, df.columns))) for n in ("bucket", "bits", "at"))
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(MARKS)) + 1
    placed = df.withColumn(at, place).withColumn(bucket, F.bitmap_bucket_number(at))
    held = placed.join(F.broadcast(bitmap.toDF(bucket, bits)), bucket, "left")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_marked = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)) & F.col(column).isNotNull()
    plain = [F.col(f"`{c}`") for c in df.columns]
    return held.filter(~is_marked).select(*plain), held.filter(is_marked).select(*plain)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

