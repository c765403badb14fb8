"""What the training-data operators share: table reading, the shared scratch folder, Arrow column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, [\x20\x09-\x0D]. ``bytes.split()`` and ``bytes.strip()`` use exactly these.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows and bytes that one Arrow batch to a Python worker holds at most; very long texts make smaller batches.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20

_OWN_DIR: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker's memory doesn't depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in a local session only, one of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], True)
    return _OWN_DIR[app]


def stash(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors.

    by: a column with few values; a filter on it then reads the files of these values only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspan/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspan_path = path  # noqa: SLF001
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete what stash() wrote; no frame that reads it may be used afterwards."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._quillspan_path)  # noqa: SLF001
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


class MaybeIn:
    """A Bloom filter of long keys, at most ``MOST`` words of 64 bits, whatever the number of keys: beyond some 16
    million keys it only lets more through. Four bits of one word for each key."""

    MOST, KEYS_A_WORD = 4 << 20, 4

    def __init__(self, keys: DataFrame, key: str) -> None:
        n = keys.count()
        self.words = min(max(64, n // self.KEYS_A_WORD), self.MOST)
        h = self.hashed(F.col(key))
        mask = None
        for k in range(4):
            bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h, {40 + 6 * k}) & 63 as int))")
            mask = bit if mask is None else mask.bitwiseOR(bit)
        rows = keys.select(h.alias("_h")).select(F.pmod("_h", F.lit(self.words)).alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
        table_ = np.zeros(self.words, np.int64)
        table_[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
        self.table = keys.sparkSession.sparkContext.broadcast(table_)

    def mask(self, hashes: np.ndarray) -> np.ndarray:
        """Whether keys of these xxhash64 may be among the filter's; True for all that are."""
        u = hashes.view(np.uint64)
        bits = np.zeros(len(u), np.uint64)
        for k in range(4):
            bits |= np.uint64(1) << ((u >> np.uint64(40 + 6 * k)) & np.uint64(63))
        return (self.table.value[hashes % self.words].view(np.uint64) & bits) == bits

    def __call__(self, key: Column) -> Column:
        """The same of a column of keys."""
        held = self

        @F.pandas_udf("boolean")
        def hit(h: pd.Series) -> pd.Series:
            return pd.Series(held.mask(h.to_numpy(np.int64)))

        return hit(self.hashed(key))

    @staticmethod
    def hashed(key: Column) -> Column:
        return F.xxhash64(key.cast("long"))


def aside(docs: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones renamed, so that none can clash with what an operator adds; and the way
    back to docs' columns from a frame with more."""
    low = {c.lower() for c in needed}
    names = [c if c.lower() in low else f"_aside{k}" for k, c in enumerate(docs.columns)]
    own = docs.toDF(*names)
    return own, lambda df: df.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def crc_mod(id_col: str, m: int):
    """crc32(id as text) mod m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch with columns replaced or appended; a column of the same name, in any case, is replaced."""
    low = {k.lower() for k in new}
    names = [n for n in batch.schema.names if n.lower() not in low]
    cols = [batch.column(batch.schema.names.index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*cols, *new.values()], names=[*names, *new])


def widened(schema: T.StructType, new: dict[str, T.DataType]) -> T.StructType:
    """The schema of with_columns()."""
    low = {k.lower() for k in new}
    return T.StructType([f for f in schema.fields if f.name.lower() not in low] + [T.StructField(k, v) for k, v in new.items()])


def texts(batch: pa.RecordBatch, col: str) -> list[str]:
    """The column's strings; null is the empty text."""
    return [t or "" for t in batch.column(col).to_pylist()]
