"""What the corpus operators share: reading tables, cutting lineage, column names that cannot clash."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch; with BATCH_BYTES it bounds what a Python worker holds at a time.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches for texts of any length, unless the session already has tighter bounds."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    bytes_now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if bytes_now is None or not bytes_now.isdigit() or int(bytes_now) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives memory that this process has freed back to the system; allocators keep it otherwise, and Spark reuses Python workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which releases memory after every BATCH_BYTES of its input and at its end."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch
            seen += batch.nbytes
            if seen >= BATCH_BYTES:
                seen = 0
                release()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(fed(batches))
        finally:
            release()

    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where nothing names one and the master is this one process, as in tests, a temporary one is made; elsewhere that
    would be a folder of one machine, and is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ocellus-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost no recomputation.

    Spark removes the files with the DataFrame if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Parquet tables in the shared folder for one computation. They are deleted when the `with` ends, however it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once; readers take the columns that they need."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.folder)


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever signs their names hold."""
    return [F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns]


def orderable(df: DataFrame) -> list[Column]:
    """The columns of df that can be sorted by."""

    def ok(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(ok(f.dataType) for f in t.fields)
        return ok(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))

    return [c for c, f in zip(columns(df), df.schema.fields) if ok(f.dataType)]


class KeyFilter:
    """A Bloom filter over 64-bit hashes, two bits a key: says no only to keys that it was not made of."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        out = np.ones(len(k), bool)
        for at in (k & self.mask, (k >> np.uint64(32)) & self.mask):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


#: 16 MB. Above 2^23 keys a filter of this size lets more pass that then have to be joined; it never loses one.
FILTER_BITS = 1 << 27


def key_filter(keys: DataFrame, name: str):
    """A broadcast KeyFilter of a column of 64-bit hashes: 16 bits a key, FILTER_BITS at most, made by the executors."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * keys.count()).bit_length()))
    at = F.explode(F.array(F.col(name).bitwiseAND(bits - 1), F.shiftrightunsigned(name, 32).bitwiseAND(bits - 1)))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(KeyFilter(out))


def may_hold(key: Column, filter_) -> Column:
    """Whether a broadcast KeyFilter may hold the key."""

    @F.arrow_udf("boolean")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(filter_.value.holds(keys.to_numpy(zero_copy_only=False)))

    return run(key)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever its case rules: each name, with underscores in front as needed."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def stable_sample(df: DataFrame, key: str, rows: int, salt: int = 0) -> DataFrame:
    """At most `rows` rows, the same ones in every run: those whose key has the smallest hash."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(salt)), F.col(key)).limit(rows)


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by integer key columns, each as one table, across batch borders."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for a, b in zip(first[:-1], first[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != at:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, which is kept already (it is read twice), marked for broadcast if it has at most `rows` rows; beyond that the planner joins it by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
