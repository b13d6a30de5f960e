"""Tables written between steps, and small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.resample import new_path

#: Most rows and bytes of an Arrow batch while tables are written: a batch is held several times over, in Python and outside
#: the JVM's heap. Rows of a Parquet reader's batch, whose vectors grow with long texts.
BATCH, BATCH_BYTES, READ_BATCH = 1000, 4 << 20, 512
#: Bytes that a writer holds before it writes them out as a row group.
ROW_GROUP = 16 << 20
#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind, since Spark removes them when each of its queries has ended, and
    reads and passes batches of BATCH rows and BATCH_BYTES at most."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_BATCH}
    files = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = {k: spark.conf.get(k) for k in (files, *most)}
    spark.conf.set(files, "true")
    for k, v in most.items():
        if not before[k].isdigit() or not 0 < int(before[k]) <= v:  # none or less is no limit
            spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def release() -> None:
    """Give back what a Python worker has freed: workers live on between tasks, beside the next one's JVM."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def freed(f: Callable) -> Callable:
    """A function over a task's batches that releases memory at its end."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def freed_group(f: Callable) -> Callable:
    """A function over a group's tables that releases memory at its end. It takes as many tables as f does."""
    if f.__code__.co_argcount == 1:
        return lambda one: _released(f, one)
    return lambda one, two: _released(f, one, two)


def _released(f: Callable, *tables: pa.Table) -> pa.Table:
    try:
        return f(*tables)
    finally:
        release()


def stash(df: DataFrame, tag: str, parts: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    parts: for tables of few bytes a row, the most files to write; it follows the number of rows.
    """
    path = new_path(df.sparkSession, tag)
    with tidy(df.sparkSession):
        (df.coalesce(parts) if parts else df).write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(*cols) -> F.Column:
    """A number in [0, 1) that depends on the given columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def let(value, body):
    """body(value), with value computed once for each row: a lambda over an array of one."""
    return F.transform(F.array(value), body)[0]


def repeated(df: DataFrame, n: str, k: str, run: int = 10_000) -> DataFrame:
    """Each row as often as its column n says, numbered from 0 in column k; n is dropped. Rows of more than run repeats are
    dealt over the tasks in runs of so many."""
    rest = [c for c in df.columns if c != n]
    count, first = F.col(n).cast("long"), F.lit(0).cast("long")
    few = df.where(count.between(1, run)).select(*rest, F.explode(F.sequence(first, count - 1)).alias(k))
    runs = df.where(count > run).select(*rest, count.alias("__n"), F.explode(F.sequence(first, count - 1, F.lit(run).cast("long"))).alias("__from")).repartition(F.xxhash64("__from", *rest))
    many = runs.select(*rest, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + run, F.col("__n")) - 1)).alias(k))
    return few.unionByName(many)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it is read in fewer parts than there are: a table that is one file's row group, say.
    Larger tables aren't shuffled. The parts are counted from the files' footers."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id()).count().count()
    return df.repartition(2 * cores) if 0 < parts < cores else df


def ranked(df: DataFrame, order, name: str) -> DataFrame:
    """df with each row's place, from 0, in an order, without a task that holds all rows: places within sorted parts, and the
    parts' sizes, of which there are as many as tasks."""
    x = stash(df.orderBy(order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    x = x.withColumn("__part", F.shiftright("__id", 33))
    sizes = x.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("__before") + F.col("__id") - F.shiftleft("__part", 33)
    return x.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn(name, at).drop("__id", "__part", "__before")


def small(df: DataFrame, limit: int) -> DataFrame:
    """df with a broadcast hint if it has no more than limit rows; otherwise Spark shuffles, splitting skewed partitions."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def parts_for(rows: int) -> int:
    """Files for a table of few bytes a row: enough for all cores of a small cluster, then one for each 50,000 rows."""
    return max(12, rows // 50_000)


__all__ = ["WORD", "freed", "freed_group", "let", "new_path", "parts_for", "ranked", "release", "repeated", "small", "spread", "stash", "table", "tidy", "uniform"]
