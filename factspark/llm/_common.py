"""Helpers that the training-data operators share: staged tables in the cluster's shared folder, Arrow mapping, links to components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_watching: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one."""
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        tmp = tempfile.TemporaryDirectory(prefix="factspark-")
        atexit.register(tmp.cleanup)
        _own_dir.append(f"file://{tmp.name}")
    return _own_dir[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors, is read as often as needed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    for made in _watching:
        made.append(out)
    return out


@contextmanager
def watched() -> Iterator[list[DataFrame]]:
    """The tables that are staged meanwhile, so that whoever knows them to be read for the last time can discard them."""
    made: list[DataFrame] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.remove(made)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing still to be computed reads: what was made of them must be staged itself."""
    for df in tables:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(hadoop).delete(path, True)


def released() -> None:
    """Gives what this Python worker has freed back to the machine: workers outlive tasks and wait beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that Python holds the objects of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    released()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges, for each id on an edge to another.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the edges stand still: each step is one min per
    key (combined map-side) and one join, and holds at most as many edges as the step before; nothing comes to the driver but
    a count and a checksum. Edges with a null end or equal ends are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = staged(e, "edges")
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, e = e, staged(small.where("u <> v").distinct(), "edges")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
