"""What the training-corpus operators share: tables, spooled intermediate tables, the split into words, held-out rows."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract counts words: a run of anything but ASCII blanks. ``bytes.split()`` cuts in the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where that is unset and all runs in one local process, as in tests) a new one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="docweave-")
        atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return named


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    It cuts the lineage, survives lost executors and, unlike checkpoint(), keeps columns prunable and sizes known to the optimiser.
    """
    spark = df.sparkSession
    to = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    out = spark.read.schema(df.schema).parquet(to)
    out._spooled_to = to
    return out


def unspool(*frames: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more. Call it once all that was derived from them has been written."""
    for df in frames:
        spark, to = df.sparkSession, df._spooled_to
        path = spark._jvm.org.apache.hadoop.fs.Path(to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch that goes to Python. Spark's own limit is 64 MB, which a task holds several times over in the JVM and the worker; a session's other setting is left alone.
BATCH_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where PYTHONPATH does not name it already, and bound the batches that go there."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) == "67108864b":
        spark.conf.set(limit, BATCH_BYTES)
    root = Path(__file__).resolve().parents[2]
    known = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(root) in known or os.path.realpath(os.getcwd()) == str(root) or getattr(spark.sparkContext, "_docweave_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="docweave-")) / "docweave.zip"
    atexit.register(shutil.rmtree, str(to.parent), True)
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "docweave").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._docweave_shipped = True


def lean(run):
    """``run`` for mapInArrow, giving memory back to the system when a task has ended: workers stay for later tasks, and what they keep is missing to the next stage of an executor."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than glibc's
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds = fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds) == F.lit(fold)


def text_slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Cut a column of texts into slices of about ``most`` bytes (one longer text is a slice), each a (from, to) pair, so that work on one slice has bounded memory. Only lengths are looked at."""
    if not len(texts):
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(texts)
    while start < n:
        before = int(upto[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield start, end
        start = end


def each_text(texts: pa.Array, most: int = 2 << 20) -> Iterator[str | None]:
    """The texts of a column one after another; no more than a slice of them are Python strings at a time."""
    for i, j in text_slices(texts, most):
        yield from texts.slice(i, j - i).to_pylist()


def output_columns(df: DataFrame, taken: list[str]) -> list[str]:
    """The columns of ``df`` that an operator hands through: all but those whose names it gives to its own results (names compare without case)."""
    low = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in low]


def field_list(df: DataFrame, names: list[str]) -> str:
    """These columns as a DDL list, for what mapInArrow returns."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)
