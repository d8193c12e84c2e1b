"""What several operators need: written intermediate tables, components of a graph, ranks within keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or on one machine a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("quillion.checkpoint.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="quillion-")
            spark.conf.set("quillion.checkpoint.dir", folder)
    return folder


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Within, the paths of the tables that stash() writes are added to ``paths``."""
    before = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(before)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that stash() wrote and empties the list; only for tables that nothing reads any more."""
    while paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and lost executors lose nothing."""
    return stashed(df, name)[0]


def stashed(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """stash() and the path, for remove(). compression: of the Parquet files, where it is not to be the session's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quillion-{name}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    with _shuffles_dropped(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


#: Bytes of an Arrow batch, and the setting of it that sessions begin with.
BATCH = "8m"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Lets a batch of whole texts take BATCH bytes, on both sides of the Python boundary, unless the session says otherwise."""
    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH)


def give_back() -> None:
    """Returns the memory that a task's texts took to the system, as the worker waits for its next task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of the edges' graph; root is the component's smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each a minimum per node
    (combined before the shuffle) and an equi-join that adaptive execution may split; a written table ends
    the lineage of every round. Rounds grow with the logarithm of a component's diameter. Nulls and
    loops are ignored; an empty edge table gives an empty result.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        """links: u, v. Large: nodes above u go to u's minimum. Small: nodes below u, and u, go to it."""
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        if large:
            least = least.select("u", F.least("u", "m").alias("m"))
            moved = links.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = links.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        moved = moved.where("a > b")
        return moved if large else moved.distinct()  # the next step's minima take repeated links as they are

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    spark = edges.sparkSession
    now, path = stashed(
        edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct(), "edges"
    )
    before = state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, True)
        old = path
        now, path = stashed(star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "edges")
        remove(spark, [old])
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


#: Rows and written bytes that small() lets be broadcast.
FEW, FEW_BYTES = 100_000, 4 << 20


def small(df: DataFrame) -> DataFrame:
    """df written to the shared folder, with a broadcast hint if it has FEW rows and FEW_BYTES at most; else joins shuffle it."""
    kept, path = stashed(df, "small")
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    written = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return F.broadcast(kept) if written <= FEW_BYTES and kept.count() <= FEW else kept


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df, written to the shared folder, with each sum over the rows before it in the order. No task holds all rows: ranges of the order
    are summed by themselves, and one row a range tells what is before it."""
    ranges = stash(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of the ranges alone
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(F.broadcast(starts), "_range")
    return out.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).drop("_range", *(f"_{n}" for n in sums))


def ranked(df: DataFrame, keys: list[str], order: list[Column], weight: str | None = None, shuffled: Column | None = None) -> DataFrame:
    """Adds ``rank`` (0, 1, ... within the keys, in a shuffled order) and, with a weight, ``before`` (its sum over lower ranks).

    The order is that of a hash of ``order`` (``shuffled``, if given), cut into about sqrt(rows of the key) buckets, so that no task
    ever holds a whole key: sums per bucket give each bucket's start, and ranks run inside a bucket. The
    result depends on the rows alone. keys must not be null. df is read three times; pass a stashed table.
    """
    amount = F.col(weight) if weight else F.lit(0).cast("long")
    spread = df.groupBy(*keys).agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("_buckets"))
    dealt = df.join(small(spread), keys).withColumn("_hash", F.xxhash64(*order) if shuffled is None else shuffled)
    dealt = dealt.withColumn("_bucket", F.pmod("_hash", "_buckets"))
    starts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"), F.sum(amount).alias("_w"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rank0"), F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_before0")
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy("_hash", *order)
    out = dealt.join(starts, [*keys, "_bucket"]).withColumn("rank", F.col("_rank0") + F.row_number().over(within) - 1)
    if weight:
        running = F.coalesce(F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("before", (F.col("_before0") + running).cast("long"))
    return out.drop("_buckets", "_hash", "_bucket", "_rank0", "_before0").withColumn("rank", F.col("rank").cast("long"))
