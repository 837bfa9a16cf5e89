"""What the training-data operators share: tables, shared storage, Arrow batches, components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes that one vectorised step handles; only a single longer text exceeds it.
SLICE_BYTES = 1 << 20
#: Bits of a mask of ids, 1 MB.
MASK_BITS = 1 << 23
#: Bytes of records that a bucket of a shuffle is meant to hold.
BUCKET_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    It is set here only where it is unset, and only in local mode: on a cluster a
    machine-local folder would lose what other executors have to read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="caseflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths made inside each open ``scratch``, the innermost last.
SCRATCH: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if SCRATCH:
        SCRATCH[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes all intermediate tables that are made inside; results go to paths made before."""
    SCRATCH.append([])
    try:
        yield
    finally:
        for path in SCRATCH.pop():
            drop_path(spark, path)
        release(spark)


#: Rows of a batch between Spark and Python: texts are long, and a batch is held several times at once.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def small_batches(spark: SparkSession) -> str:
    """Sends texts to Python in batches of BATCH_ROWS from now on; what was set before."""
    before = spark.conf.get(BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    return before


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path, before = new_path(spark, label), small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path), path


def may_be_among(column: Column, ids: DataFrame) -> Column:
    """True for every value that the first column of ``ids`` holds, and for few others; null counts as none.

    A bitmap of MASK_BITS bits by hash, whatever the number of ids: rows for which it is false need not be shuffled to
    meet ``ids``.  The more ids there are, the more rows it lets pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(MASK_BITS))
    name = ids.columns[0]
    set_bits = ids.where(F.col(name).isNotNull()).select(place(F.col(name)).alias("at"))
    words = set_bits.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    all_words = ids.sparkSession.range(0, MASK_BITS // 64, numPartitions=1).select(F.col("id").cast("int").alias("word"))
    dense = all_words.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    mask = dense.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("all")).select(F.col("all.bits").alias("mask"))
    mask, _ = materialize(mask, "mask")  # one row
    at = place(column)
    return column.isNotNull() & (F.getbit(F.get(mask.scalar(), (at / 64).cast("int")), (at % 64).cast("int")) == 1)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished steps go now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def free_prefix(columns: list[str]) -> str:
    """What no column's name begins with, for columns of the plan's own."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def hide(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """The frame with names that nothing clashes with, but for those used, and what selects its columns as they were."""
    prefix = free_prefix(docs.columns)
    names = {c: c if c in used else prefix + c for c in docs.columns}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def buckets_for(docs: DataFrame, column: str, per_byte: float, most: int = 1 << 20) -> int:
    """A power of two: so many buckets that each gets BUCKET_BYTES, if a byte of text makes ``per_byte`` bytes of records."""
    text_bytes = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, 1 << max(5, (max(least, int(text_bytes * per_byte / BUCKET_BYTES)) - 1).bit_length()))


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty), and the n + 1 offsets into them."""
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph of long node ids, as ``node, component``.

    ``edges``: columns ``a`` and ``b``; nulls and self loops are ignored.  The component is the
    smallest node id in it.  Only nodes that have an edge are returned.  Large-star and small-star
    rounds (Kiveris et al., 2014) run until nothing changes; every round is written to the shared
    folder, and only its row count and checksum reach the driver.  A node with very many
    neighbours is no bottleneck: minima are pre-aggregated before the shuffle, and the join that
    spreads them reads two written tables, so that adaptive execution can split its hot keys.
    """
    spark = edges.sparkSession

    def stars(sym: DataFrame, label: str) -> tuple[DataFrame, str, str]:
        least, at = materialize(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        return sym.join(least, "u"), at, label

    def seal(df: DataFrame, label: str) -> tuple[DataFrame, str, tuple]:
        out, at = materialize(df.distinct(), label)
        mark = out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return out, at, tuple(mark)

    now, path, mark = seal(
        edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")),
        "edges",
    )
    while mark[0]:
        sym = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        joined, at, _ = stars(sym, "least")
        large, large_path, _ = seal(joined.where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")), "large")
        drop_path(spark, at)
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        joined, at, _ = stars(down, "least")
        small = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
        following, next_path, next_mark = seal(small.where("a != b"), "small")
        for old in (at, large_path, path):
            drop_path(spark, old)
        done = next_mark == mark
        now, path, mark = following, next_path, next_mark
        if done:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
