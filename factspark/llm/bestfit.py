"""Packing by best-fit decreasing over all documents at once: a segment tree over remaining capacities finds the tightest open bins."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import slices, staged
from .tokens import encoder

LENGTH = 2048
#: Words whose ids a worker keeps; rows of (partition, size) counts that are broadcast at most.
CACHE, BROADCAST_COUNTS = 400_000, 1_000_000


class Capacities:
    """Open bins by what they have left, as stretches of equal neighbours: the leaves of a segment tree are capacities, a node
    tells how many stretches lie below it."""

    def __init__(self, room: int):
        self.leaves = 1
        while self.leaves <= room:
            self.leaves *= 2
        self.below = [0] * (2 * self.leaves)
        self.open: dict[int, list[tuple[int, int]]] = {}

    def _count(self, left: int, by: int) -> None:
        at = left + self.leaves
        while at:
            self.below[at] += by
            at //= 2

    def put(self, left: int, first: int, bins: int) -> None:
        if left and bins:
            self.open.setdefault(left, []).append((first, bins))
            self._count(left, 1)

    def take(self, size: int) -> tuple[int, int, int] | None:
        """(left, first bin, bins) of the stretch with the least left that is at least size, or None."""
        at = size + self.leaves
        if not self.below[at]:
            # up to where a right sibling has stretches, then down to its first
            while at > 1 and (at & 1 or not self.below[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.below[2 * at] else 2 * at + 1
        left = at - self.leaves
        self._count(left, -1)
        return left, *self.open[left].pop()


def best_fit_decreasing(counts: dict[int, int], room: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, bins): runs (size, first, per_bin, bin, offset), in which the pieces of that size numbered from `first` on fill
    bin, bin + 1, ... with per_bin pieces each, from offset on, up to the next run of the size.

    Just what best-fit decreasing does piece by piece: after a piece, the bin it went to is the tightest that has room for the
    next of its size, as long as it has room; so equal pieces fill equal bins one by one, and are dealt with together. There is
    a run per stretch and size that fits; stretches grow by four a size at most and a bin holds at most 63 different sizes of
    2,048, so the table is small however many pieces there are.
    """
    tree, runs, bins = Capacities(room), [], 0
    for size in sorted(counts, reverse=True):
        todo, first = counts[size], 0
        while todo:
            if (found := tree.take(size)) is None:
                n = -(-todo // (room // size))
                found, bins = (room, bins, n), bins + n
            left, at, n = found
            per = left // size
            used = min(n, -(-todo // per))
            m = min(todo, used * per)
            runs.append((size, first, per, at, room - left))
            tree.put(left - per * size, at, m // per)
            if m % per:
                tree.put(left - m % per * size, at + m // per, 1)
            tree.put(left, at + used, n - used)
            todo, first = todo - m, first + m
    return runs, bins


def pieces(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents as ids (with the end id). Only those of more than `length` ids are cut, and of their pieces only the first may be
    shorter: doc_id, piece, start, length, ids (little-endian u32), and task and nth (number among its task's pieces of that length)."""

    def run(batches):
        e, task = encoder(path, CACHE), TaskContext.get().partitionId()
        end, seen = np.array([end_id], e.dtype).tobytes(), [0] * (length + 1)
        for b in slices(batches, 256):
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(e.encode(t) + end, e.dtype).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    n = (len(ids) - at - 1) % length + 1 if not at else length
                    out.append((doc, piece, at, n, ids[at : at + n].tobytes(), task, seen[n]))
                    seen[n] += 1
                    at, piece = at + n, piece + 1
            cols = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids binary, task int, nth long"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, schema)


def seats(runs: Iterable[tuple[int, int, int, int, int]]):
    """size, number -> (bin, offset), for arrays of both."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    size, first, per, at, offset = table.T
    starts = np.searchsorted(size, np.arange(int(size.max()) + 2 if len(size) else 1))

    def look(sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for s in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == s)
            lo, hi = starts[s], starts[s + 1]
            run = lo + np.searchsorted(first[lo:hi], numbers[mine], side="right") - 1
            inside = numbers[mine] - first[run]
            bins[mine] = at[run] + inside // per[run]
            offsets[mine] = offset[run] + inside % per[run] * s
        return bins, offsets

    return look


def pack(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    All pieces are packed together: their lengths' counts (at most `length` of them) are all that best-fit decreasing looks at,
    and a piece's place follows from its number among the pieces of its length. Numbers come from the written table: within
    the task that cut the piece, after those of the tasks before. The ids are never shuffled, unless tasks times lengths pass
    BROADCAST_COUNTS. Each id lies in exactly one piece; a sequence's offsets run from 0 without a gap. A null or empty text is
    its end id alone; repeated rows are documents of their own, as are those without id; an empty table gives no rows; other columns are left
    out, whatever their names.
    """
    rows = staged(pieces(docs, path, end_id, length, text, id_col), "pieces")
    counts = staged(rows.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    runs, _ = best_fit_decreasing({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    base = F.broadcast(base) if counts.count() <= BROADCAST_COUNTS else base
    schema = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def place(batches):
        look = seats(runs)
        for b in slices(batches):
            bins, offsets = look(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins), pa.array(offsets)], names)

    numbered = rows.join(base, ["task", "length"]).select(*names[:5], (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(place, schema)


def op13_best_fit(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
