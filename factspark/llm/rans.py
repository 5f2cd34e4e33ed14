"""Token ids in a binary format: independent blocks of interleaved static range-ANS under one shared frequency table.

A block holds at most BLOCK ids, dealt in turn to up to LANES coder states that share one stream of 32-bit words. Every block
carries its states, word count and CRC-32, and lists the documents whose ids it holds, so any block decodes alone. The table of
frequencies is exact over all ids, scaled to 2**SCALE_BITS, and is stored once beside the blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, shuffle_parts, staged
from .tokens import encoder

BLOCK, LANES, SCALE_BITS = 1 << 17, 1024, 20
_LOW = np.uint64(1 << 31)


class Table:
    """Static frequencies: symbols (ids that occur), their scaled frequencies and starts."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int = SCALE_BITS):
        self.ids, self.bits = ids.astype(np.uint32), bits
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.index = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        self.index[ids] = np.arange(len(ids))

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> Table:
        """Counts scaled so that each symbol has 1 at least and all make 2**bits."""
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order].astype(np.float64)
        total = 1 << bits
        if len(ids) > total:
            raise ValueError("more symbols than the scale can hold")
        freq = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        while len(ids) and (off := total - int(freq.sum())):
            # what is left over goes to, or comes from, the most frequent symbols, where it costs least
            top = np.argsort(-freq, kind="stable")[: max(1, min(len(freq), abs(off)))]
            top = top[freq[top] > 1] if off < 0 else top
            freq[top[: abs(off)]] += 1 if off > 0 else -1
        return cls(ids, freq, bits)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, t: Table) -> tuple[bytes, bytes]:
    """(states, words): id i goes to lane i mod lanes; words stand in the order in which the decoder reads them."""
    lanes = min(LANES, len(ids))
    sym = t.index.take(ids)
    freq, start = t.freq.take(sym), t.start.take(sym)
    x = np.full(lanes, _LOW, np.uint64)
    bits, top = np.uint64(t.bits), np.uint64(31 - t.bits + 32)
    words = []
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f, s = freq[at : at + lanes], start[at : at + lanes]
        y = x[: len(f)]
        if (over := y >= (f << top)).any():
            words.append(y[over].astype(np.uint32))
            y[over] >>= np.uint64(32)
        q = y // f
        x[: len(f)] = (q << bits) + (y - q * f) + s
    return x.astype("<u8").tobytes(), np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""


def decode_block(states: bytes, words: bytes, n: int, t: Table, slots: np.ndarray) -> np.ndarray:
    x = np.frombuffer(states, "<u8").astype(np.uint64)
    w, used, lanes = np.frombuffer(words, "<u4"), 0, len(x)
    out = np.empty(n, np.uint32)
    bits, mask = np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
    for at in range(0, n, lanes):
        y = x[: min(lanes, n - at)]
        low = y & mask
        sym = slots.take(low.view(np.int64))
        out[at : at + len(y)] = t.ids.take(sym)
        y = t.freq.take(sym) * (y >> bits) + low - t.start.take(sym)
        if k := int(np.count_nonzero(under := y < _LOW)):
            y[under] = (y[under] << np.uint64(32)) | w[used : used + k]
            used += k
        x[: len(y)] = y
    if used != len(w) or (x != _LOW).any():
        raise ValueError("a block is damaged")
    return out


def crc_of_parts(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from the (length in bytes, CRC-32) of its parts."""
    out = 0
    for size, crc in parts:
        out = _shifted(out, size) ^ crc
    return out


def _shifted(crc: int, size: int) -> int:
    """crc after size zero bytes more, without the pre- and post-conditioning."""
    for i in range(size.bit_length()):
        if size >> i & 1:
            crc = _apply(_zero_bytes(i), crc)
    return crc


@cache
def _zero_bytes(i: int) -> list[int]:
    """The step of 2**i zero bytes over GF(2): powers of the one-bit shift, each made once a worker."""
    square = lambda m: [_apply(m, c) for c in m]
    return square(_zero_bytes(i - 1)) if i else square(square(square([0xEDB88320, *(1 << k for k in range(31))])))


def _apply(m: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


def tokenize(docs: DataFrame, path: str, end_id: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and ids: the ids of the whole text and the end id, little-endian (2 bytes each up to 65,536 ids, else 4)."""

    def run(batches):
        e = encoder(path)
        end = np.array([end_id], e.dtype).tobytes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x + end for x in e.encode_each(b.column(1))], pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, "id long, ids binary")


def count_ids(tokens: DataFrame, width: int) -> Table:
    """The shared table, exact over all ids; at most a row per id of the vocabulary comes to the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.column(0).slice(at, 256)
                joined = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), b"")[0].as_buffer()
                c = np.bincount(np.frombuffer(joined, f"<u{width}"))
                if len(c) > len(total):
                    total = np.pad(total, (0, max(len(c), 2 * len(total)) - len(total)))
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["i", "c"])

    rows = tokens.select("ids").mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()
    return Table.of_counts(np.array([r["i"] for r in rows], np.int64), np.array([r["c"] for r in rows], np.int64))


_FILE = "part int, block int, first long, n int, states binary, words binary, crc32 long, ordinals array<long>, doc_ids array<long>, begins array<long>, lengths array<long>"


def write_tokens(tokens: DataFrame, table: Table, width: int, name: str = "token-file", parts: int | None = None) -> DataFrame:
    """The file: rows of blocks in ascending id order (part, block), written to the shared folder. A document may run over
    blocks; each lists the documents it holds by ordinal in the part, id, first id's place in the document, and length."""
    parts = parts or shuffle_parts(tokens.sparkSession)
    rows = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "ids")

    def run(batches):
        part, block, first, ordinal = TaskContext.get().partitionId(), 0, 0, -1
        held: list[np.ndarray] = []
        size, listed = 0, []
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, at = np.frombuffer(raw.as_buffer(), f"<u{width}"), 0
                ordinal += 1
                while at < len(ids):
                    take = min(len(ids) - at, BLOCK - size)
                    held.append(ids[at : at + take])
                    listed.append((ordinal, doc, at, take))
                    size, at = size + take, at + take
                    if size == BLOCK:
                        yield _block(part, block, first, np.concatenate(held), listed, table)
                        block, first, held, size, listed = block + 1, first + size, [], 0, []
        if size:
            yield _block(part, block, first, np.concatenate(held), listed, table)

    return staged(rows.mapInArrow(run, _FILE), name)


def _block(part: int, block: int, first: int, ids: np.ndarray, listed: list, t: Table) -> pa.RecordBatch:
    states, words = encode_block(ids, t)
    many = pa.list_(pa.int64())
    cols = [[part], [block], [first], [len(ids)], [states], [words], [zlib.crc32(ids.astype("<u4").tobytes())]] + [[[x[i] for x in listed]] for i in range(4)]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), many, many, many, many]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], [x.split()[0] for x in _FILE.split(", ")])


def decoded(blocks: DataFrame, table: Table, with_ids: bool = True) -> DataFrame:
    """The documents' pieces, every block decoded on its own and checked: part, ordinal, doc_id, start (in the part), begin (in
    the document), n, crc32, and, if asked for, ids (little-endian unsigned 32-bit)."""
    names = ["part", "ordinal", "doc_id", "start", "begin", "n", "crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]):
        slots = table.slots()
        for b in batches:
            for r in b.to_pylist():
                ids = decode_block(r["states"], r["words"], r["n"], table, slots).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["crc32"]:
                    raise ValueError(f"block {r['part']}, {r['block']} is damaged")
                ends = np.cumsum(r["lengths"])
                cut = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), r["lengths"], strict=True)]
                cols = [[r["part"]] * len(cut), r["ordinals"], r["doc_ids"], (r["first"] + ends - r["lengths"]).tolist(), r["begins"], r["lengths"], [zlib.crc32(c) for c in cut], *[cut] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 7 else pa.int32() if not i else pa.int64()) for i, c in enumerate(cols)], names)

    return blocks.mapInArrow(run, "part int, ordinal long, doc_id long, start long, begin long, n long, crc32 long" + ", ids binary" * with_ids)


def read_index(blocks: DataFrame, table: Table) -> DataFrame:
    """A row per document as read from the file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Documents without id come first, repeated rows are documents of their own; a null text holds the end id alone; an empty
    table gives no rows.
    """
    pieces = decoded(blocks, table, with_ids=False)
    docs = pieces.groupBy("part", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("begin", "n", "crc32"))).alias("pieces"))
    sizes = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each range partition
    ahead = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    joined = docs.join(F.broadcast(ahead), F.col("part") == F.col("p")).select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "pieces")

    def run(batches):
        for b in batches:
            crc = [p[0]["crc32"] if len(p) == 1 else crc_of_parts([(4 * x["n"], x["crc32"]) for x in p]) for p in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_rans_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    tokens = staged(tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), "tokens")
    width = encoder(path).dtype.itemsize
    table = count_ids(tokens, width)
    blocks = write_tokens(tokens, table, width)
    discard(tokens)
    return read_index(blocks, table)
