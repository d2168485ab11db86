"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null identifier inside join keys; null identifiers are returned as null.
NULL_KEY = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local session gets a folder of its own; any other
    master is refused, since its executors could not read that folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quireworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_recorder: contextvars.ContextVar[list[Workspace] | None] = contextvars.ContextVar("recorder", default=None)


@contextlib.contextmanager
def recording() -> Iterator[list[Workspace]]:
    """Lists the Workspaces that are opened inside, so that they can be closed once what reads them is written."""
    opened: list[Workspace] = []
    token = _recorder.set(opened)
    try:
        yield opened
    finally:
        _recorder.reset(token)


class Workspace:
    """Parquet tables under the shared folder that cut lineage between steps.

    A lost executor costs at most the step that runs: each step rereads its
    input from these files.  ``drop`` removes tables no later step reads,
    ``close`` all of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        if (opened := _recorder.get()) is not None:
            opened.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        # what was shuffled for this table is not read again: collecting the driver's garbage lets Spark delete it
        self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out.saved_path = path
        return out

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(frame.saved_path)

    def close(self) -> None:
        self._delete(self.root)


#: Bytes of rows that are sent to a Python worker at once, about: the executor and the worker hold a batch several times over.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python end at about BATCH_BYTES; a lower bound that it has stays."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


Step = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(step: Step) -> Step:
    """``step`` for mapInPandas; a worker that is used again holds no memory of it while other steps run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from step(batches)
        give_back()

    return run


def key_of(column: str = "doc_id") -> Column:
    """Join key for an identifier that may be null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: A bitmap of keys has so many bits, whatever the number of keys; in blocks of 32,768 bits (4 KiB).
BITMAP_BITS, BLOCK_BITS = 1 << 23, 32_768


def mark_possible(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """``rows`` with the flag ``name``: false only where ``keys`` surely holds no equal ``on``.

    The keys become a bitmap of fixed size (1 MiB), which alone is broadcast.
    The flag saves shuffling what no key can match; more keys than the bitmap
    tells apart only make it less selective, never wrong.
    """
    at = F.pmod(F.xxhash64(*on), F.lit(BITMAP_BITS))
    blocks = keys.select(at.alias("_at")).groupBy((F.expr(f"_at div {BLOCK_BITS}")).alias("_block")).agg(
        F.bitmap_construct_agg(F.expr(f"_at % {BLOCK_BITS}")).alias("_bits"))
    rows = rows.withColumn("_at", at).withColumn("_block", F.expr(f"_at div {BLOCK_BITS}"))
    rows = rows.join(F.broadcast(blocks), "_block", "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_at % {BLOCK_BITS}) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1")
    rows = rows.withColumn("_byte", byte).withColumn(name, F.coalesce(bit == 1, F.lit(False)))
    return rows.drop("_at", "_block", "_bits", "_byte")


def matching(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``rows`` with an equal ``on`` in ``keys``; the bitmap keeps most others out of the shuffle.

    ``keys`` is read twice; give a written table.
    """
    return mark_possible(rows, keys, on, "_maybe").filter("_maybe").drop("_maybe").join(keys, on, "left_semi")
