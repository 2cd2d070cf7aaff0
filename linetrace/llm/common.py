"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and U+0009 to U+000D.  They never occur inside a UTF-8 sequence.
SPACES = "\\x20\\x09-\\x0D"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only where that is
    unset and everything runs in one process (tests) a temporary folder takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := f"file://{tempfile.mkdtemp(prefix='linetrace-')}")
    return made


def stash(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, a lost executor
    costs nothing, and the optimiser knows the real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Stash = Callable[[DataFrame], DataFrame]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Stash]:
    """A ``stash`` for the length of a block: all that it has written is deleted at the end.  What
    leaves the block must not read it any more, so results are written by ``stash`` before."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of two or three numbers that are sent to all executors, some 4 MB; more are joined by shuffles.
FEW = 1 << 17


def sent_if_few(keys: DataFrame) -> DataFrame:
    """A broadcast of rows of a few numbers, if there are at most ``FEW``."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null and blank texts have none."""
    bare = F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, F.split(bare, f"[{SPACES}]+")).otherwise(
        F.array().cast("array<string>")
    )


def n_words(text: Column) -> Column:
    """Number of those words, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data bytes, offsets and presence of a string array (null: no bytes)."""
    present = np.asarray(column.is_valid())
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at, present


def slices(at: np.ndarray, most: int = 1 << 20):
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def carried(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text, two hashes that name a row, and the whole row, so that no column of
    the caller's meets a name of ours.  ``select("row.*")`` gives the rows back."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), F.struct(*[docs[c] for c in docs.columns]).alias("row")
    )
