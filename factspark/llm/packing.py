"""Packing by first-fit decreasing: a tournament tree over the bins' free room, run on its own in randomised groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, staged
from .tokens import encoder

LENGTH, GROUP = 4096, 1024
#: Words whose ids a worker keeps.
CACHE = 400_000


class Tournament:
    """The free room of up to n bins, as the leaves of a binary tree whose nodes hold the larger room below them."""

    def __init__(self, n: int, room: int):
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.room = [room] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first bin with room for size; its room shrinks."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found, at = at - self.leaves, at // 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
        return found


def first_fit_decreasing(sizes: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every size: largest first, equal sizes as they come, each to the first bin that has room."""
    tree = Tournament(max(1, len(sizes)), room)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        free_at = tree.put(int(sizes[i]))
        bins[i] = free_at
        offsets[i] = room - tree.room[free_at + tree.leaves] - int(sizes[i])
    return bins, offsets


def pieces(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents as ids (with the end id), cut every `length` ids: doc_id, start, length, doc_tokens, ids (little-endian u32),
    and task and nth, a piece's number among those of the task that cut it."""

    def run(batches):
        e, task, nth = encoder(path, CACHE), TaskContext.get().partitionId(), 0
        end = np.array([end_id], e.dtype).tobytes()
        for b in slices(batches, 256):
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(e.encode(t) + end, e.dtype).astype("<u4")
                out += [(doc, at, min(length, len(ids) - at), len(ids), ids[at : at + length].tobytes()) for at in range(0, len(ids), length)]
            cols = zip(*out, strict=True) if out else [[]] * 5
            cols = [pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([task] * len(out), pa.int32()), pa.array(range(nth, nth + len(out)), pa.int64())], ["doc_id", "start", "length", "doc_tokens", "ids", "task", "nth"])
            nth += len(out)

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, task int, nth long")


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, group: int = GROUP, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    Documents are cut every `length` ids. A full piece is a sequence of its own; what is left of each document, one piece at
    most, is packed within groups of about `group` pieces drawn by the hash of their number in the written table, so rows alike in
    all their columns are spread like others. Full pieces come in groups of that size too, as there are no more of them than bytes / length. Each id lies in exactly one piece, and
    a sequence's offsets run from 0 without a gap. A null or empty text is its end id alone; repeated rows are documents of
    their own; documents without id share one null id; an empty table gives no rows.
    """
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    tails, fulls = max(1, -(-n // group)), max(1, -(-size // (length * group)))
    rows = staged(pieces(docs, path, end_id, length, text, id_col), "pieces")
    chance = F.xxhash64("task", "nth")
    rows = rows.withColumn("grp", F.when(F.col("length") < length, F.pmod(chance, F.lit(tails))).otherwise(-1 - F.pmod(chance, F.lit(fulls)))).drop("task", "nth")
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), length)
        cols = [table.column(c).combine_chunks() for c in names[:5]] + [pa.array((key[0].as_py() << 32) + bins), pa.array(offsets)]
        return pa.Table.from_arrays(cols, names)

    return rows.groupBy("grp").applyInArrow(run, schema)


def op5_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
