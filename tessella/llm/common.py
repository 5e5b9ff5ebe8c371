"""Shared helpers: tables in the cluster's shared folder, ranged running totals, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where no cluster names a shared folder: only with a master on one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/tessella"
#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: While a table is written: shuffle files go when it is done, and texts reach Python in batches of a few MB, however long they are.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


class Scratch:
    """Tables of one run in the shared folder. Each cuts lineage, and a lost executor loses none of it.

    Results are read from these tables, so they stay until the session's file systems close at the driver's end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = self._path()
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet, drop the shuffle files it took, and read it again."""
        before = {key: self.spark.conf.get(key) for key in WRITING}
        try:
            for key, value in WRITING.items():
                self.spark.conf.set(key, value)
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            path = self._path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def frugal(function):
    """A function over batches that, when a task is done, gives its memory back: workers live on and serve other stages."""

    def run(batches):
        if not gc.get_freeze_count():
            gc.freeze()  # modules are not looked through again at the end of every task
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library, which keeps its own counsel
                pass

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(name: str, df: DataFrame) -> str:
    """``name``, or with underscores before it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The words of a text as an array; empty for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    """The number of words of a text (null: 0)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row.

    Adjacent projections are merged by the optimizer, and a lambda would then compute an array that it looks into anew
    for every element; a generator that makes one row keeps the projections apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def running_total(scratch: Scratch, name: str, df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``df`` with ``_before``: the sum of ``value`` over all rows that come earlier in ``order``.

    Rows are range-sorted, so a key that holds a third of them is still split; only one total for each
    partition comes to the driver. Rows equal in every column of ``order`` take any order among themselves.
    """
    spark = scratch.spark
    fields = pa.schema([*_arrow(df), ("_part", pa.int32()), ("_within", pa.int64())])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(values)
            total = int(ends[-1]) if len(ends) else total
            columns = [*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(ends - values)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = scratch.save(ranged.mapInArrow(within, _ddl(df) + ", _part int, _within long"), name)
    totals = sorted(ranged.groupBy("_part").agg(F.sum(value)).collect())
    starts = np.cumsum([0, *(n for _, n in totals)])
    offsets = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(totals, starts)], "_part int, _start long")
    return ranged.join(F.broadcast(offsets), "_part").withColumn("_before", F.col("_start") + F.col("_within")).drop("_part", "_within", "_start")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _arrow(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as an edge from each node to the smallest of its component, itself included."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (before == least).all():
            return nodes, nodes[least]


#: Edges that a task contracts at a time.
CONTRACT = 200_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, fewer and shorter: within each CONTRACT edges of a written table, stars, a > b."""
    edges = edges.coalesce(max(1, -(-edges.count() // CONTRACT)))
    kind = edges.schema["a"].dataType.simpleString()

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("a", "b"))
        nodes, least = stars(u, v)
        real = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(x[real], parts[0].column("a").type) for x in (nodes, least)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts, n = [*parts, batch], n + batch.num_rows
            if n >= CONTRACT:
                yield flush(parts)
                parts, n = [], 0
        if n:
            yield flush(parts)

    return edges.select("a", "b").mapInArrow(frugal(run), f"a {kind}, b {kind}")


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id that each endpoint of ``edges`` (a, b), a written table, reaches.

    Edges are first contracted, as many in a task as it can hold. Then alternating large-star and small-star rounds hook neighbours to the
    smallest one, in plain group-bys with a partial minimum, until every node has one edge, to a node that has none of
    its own. The minima are written before they are joined, so both sides of each join can be split where one node has
    a large share of the edges; no group is collected, and links stay on the executors.
    """
    now, k = scratch.save(contracted(edges).distinct(), f"{name}-0"), 0
    while not _starry(now):
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), f"{name}-{k}m")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.where("a <> b").distinct(), f"{name}-{k}l")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), f"{name}-{k}s")
        small = large.join(low, F.col("a") == F.col("u"))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = scratch.save(small.where("a <> b").distinct(), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}", f"{name}-{k}m", f"{name}-{k}l", f"{name}-{k}s")
        k += 1
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("component")), F.struct(F.col("b").alias("id"), F.col("b").alias("component")))
    return now.select(F.explode(ends).alias("e")).select("e.*").distinct()


def _starry(edges: DataFrame) -> bool:
    """Whether every node that has an edge (a, b) as ``a`` has just that one."""
    ends = F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up = 1 AND down = 1)").count() == 0
