"""The smallest span around each span, by one sweep over sorted spans instead of a range join."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a file that are swept in one go; longer files are cut by ranges of starts. Files that are cut, broadcast at most.
CHUNK, BROADCAST_FILES = 500_000, 100_000


class Frontier:
    """Of the spans met so far in (start, -end) order those that may be the smallest around a later one: ends and sizes both ascend.

    A span drops out when a smaller one that ends no earlier comes, so of nested spans it is the stack of open ones."""

    def __init__(self):
        self.ends: list[int] = []
        self.spans: list[tuple[int, int, str]] = []  # size, start, id

    def add(self, start: int, end: int, ident: str) -> None:
        i = bisect.bisect_left(self.ends, start)  # what ended before this start is around nothing to come
        del self.ends[:i], self.spans[:i]
        i = j = bisect.bisect_right(self.ends, end)
        new = (end - start, start, ident)
        if i and self.ends[i - 1] == end and self.spans[i - 1][:2] == new[:2]:
            self.spans[i - 1] = min(self.spans[i - 1], new)
            return
        while i and self.spans[i - 1][0] > new[0]:
            i -= 1
        self.ends[i:j], self.spans[i:j] = [end], [new]

    def around(self, end: int) -> str | None:
        i = bisect.bisect_left(self.ends, end)
        return self.spans[i][2] if i < len(self.ends) else None


def _groups(batches):
    """((file, chunk), start, end, ids of inner spans, ids of outer spans) of rows sorted by these."""
    last, inner, outer = None, [], []
    for b in batches:
        for file, chunk, start, end, ident, is_inner, is_outer in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if last != (file, chunk, start, end):
                if last:
                    yield last[:2], last[2], last[3], inner, sorted(outer)
                last, inner, outer = (file, chunk, start, end), [], []
            inner += [ident] if is_inner else []
            outer += [ident] if is_outer else []
    if last:
        yield last[:2], last[2], last[3], inner, sorted(outer)


def _table(rows: list[tuple], types: dict) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], list(types))


def _swept(batches):
    """(file, inner, outer)"""
    types = {"file": pa.string(), "inner": pa.string(), "outer": pa.string()}
    at, front, out = None, Frontier(), []
    for key, start, end, inner, outer in _groups(batches):
        if key != at:
            at, front = key, Frontier()
        for ident in inner:
            # one of the same place is as small as can be
            found = next((o for o in outer[:2] if o != ident), None) or front.around(end)
            if found is not None:
                out.append((key[0], ident, found))
        if outer:
            front.add(start, end, outer[0])
        if len(out) > 10_000:
            yield _table(out, types)
            out = []
    yield _table(out, types)


def _left_open(batches):
    """(file, chunk, start, end, id): what each chunk leaves on its frontier."""
    types = {"file": pa.string(), "chunk": pa.int64(), "start": pa.int64(), "end": pa.int64(), "id": pa.string()}
    at, front = None, Frontier()
    rows = lambda: [(*at, s[1], e, s[2]) for e, s in zip(front.ends, front.spans, strict=True)] if at else []
    for key, start, end, _, outer in _groups(batches):
        if key != at:
            yield _table(rows(), types)
            at, front = key, Frontier()
        if outer:
            front.add(start, end, outer[0])
    yield _table(rows(), types)


def enclosing(spans: DataFrame, inner: str, outer: str, chunk: int = CHUNK) -> DataFrame:
    """(file, inner, outer): for each inner span (file, id, start, end, kind) the smallest outer span of its file around it; of equal
    ones the first by start, then by id. Spans may cross each other. Inner spans that nothing is around are left out.

    One shuffle and sort by (file, start, -end), then a sweep that streams: it holds the spans that may still be around later
    ones. A file of more than `chunk` spans is cut by starts; a first sweep tells what each part leaves open, which the later
    parts that it reaches into take over."""
    rows = spans.where(F.col("kind").isin(inner, outer)).select(F.col("file").cast("string").alias("file"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("id").cast("string").alias("id"), (F.col("kind") == inner).alias("is_inner"), (F.col("kind") == outer).alias("is_outer"))
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"), F.min("start").alias("low"), F.max("start").alias("high")).where((F.col("n") > chunk) & (F.col("high") > F.col("low")))
    sizes = sizes.select("file", "low", F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / chunk))).alias("width"))
    cut = sizes.limit(BROADCAST_FILES + 1).count()
    swept = lambda df: _sorted(df).mapInArrow(_swept, "file string, inner string, outer string").withColumn("file", F.col("file").cast(spans.schema["file"].dataType))
    if not cut:
        return swept(rows.withColumn("chunk", F.lit(0).cast("long")))
    part = lambda at: F.floor((F.col(at) - F.col("low")) / F.col("width"))
    sizes = F.broadcast(sizes) if cut <= BROADCAST_FILES else sizes
    rows = rows.join(sizes, "file", "left").withColumn("chunk", F.coalesce(part("start"), F.lit(0)).cast("long"))
    left = _sorted(rows.where("width is not null and is_outer")).mapInArrow(_left_open, "file string, chunk long, start long, end long, id string")
    left = left.join(sizes, "file").withColumn("last", part("end").cast("long")).where("last > chunk")
    carried = left.withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, "last"))).select("file", "start", "end", "id", F.lit(False).alias("is_inner"), F.lit(True).alias("is_outer"), "chunk")
    return swept(rows.select(carried.columns).unionByName(carried))


def _sorted(rows: DataFrame) -> DataFrame:
    rows = rows.select("file", "chunk", "start", "end", "id", "is_inner", "is_outer")
    return rows.repartition("file", "chunk").sortWithinPartitions("file", "chunk", "start", F.desc("end"))
