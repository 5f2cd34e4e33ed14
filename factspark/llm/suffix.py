"""Suffix-array dedup: bytes of passages that start anywhere else too are removed.

Equal windows hold equal anchors (the smallest hashed gram in them), so windows are dealt to shards by anchor and meet there.
Only anchors that occur more than once are dealt. A shard holds each distinct stretch of windows once, with the number of its
occurrences; its suffix array is built by induced sorting, and permuted common prefixes tell which windows repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, released, shuffle_parts, slices, staged
from .sais import repeated_windows

WIDTH, GRAM = 200, 32
#: Window starts of one stretch, bytes of text that are hashed at once, bytes of a shard (a single anchor may exceed it).
STRETCH, CHUNK, SHARD = 2_048, 1 << 20, 1_000_000
#: An anchor of more stretches than this is split further by anchors at both ends of its windows.
HOT = 2_000
#: Rows and bytes that are broadcast at most; beyond them the same join is a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48_000_000


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` (a power of two) bytes at every place."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < size:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        step *= 2
    return h ^ (h >> np.uint64(31))


def _lowest(h: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of the `reach` values from every place on."""
    step = 1
    low = h
    while 2 * step <= reach:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[: len(h) - reach + 1], low[reach - step :]) if reach > step else low


def stretches(data: bytes, width: int = WIDTH) -> list[tuple[int, int, int, bool]]:
    """(start, starts, anchor, several) over all windows of a text: runs of window starts with one anchor. several: the anchor
    is not at one place in all of them, so that windows of the stretch may equal each other."""
    out = []
    for base in range(0, len(data) - width + 1, CHUNK - width):
        part = np.frombuffer(data, np.uint8, min(CHUNK - 1, len(data) - base), base)
        h = _grams(part, GRAM)
        # the place in the chunk breaks ties: the leftmost of equal grams
        low = _lowest((h & ~np.uint64(CHUNK - 1)) | np.arange(len(h), dtype=np.uint64), width - GRAM + 1)[: CHUNK - width]
        anchor, place = (low >> np.uint64(20)).astype(np.int64), low & np.uint64(CHUNK - 1)
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        moves = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(anchor)], strict=True):
            for t in range(s, e, STRETCH):
                n = min(STRETCH, e - t)
                out.append((base + t, n, int(anchor[t]), bool(moves[t + n - 1] != moves[t]) or e - s > STRETCH))
    return out


def _split(content: bytes, anchor: int, width: int) -> list[tuple[int, int, int]]:
    """(offset, starts, key) over a hot anchor's stretch: the key also holds the lowest grams at either end of a window, so
    windows that reach out of a common passage part from each other, and those within it are alike as a whole."""
    h = _grams(np.frombuffer(content, np.uint8), 16)
    n = len(content) - width + 1
    low = _lowest(h, 49)
    key = (low[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (low[width - 64 : width - 64 + n] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(anchor)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
    return [(s, e - s, int(key[s].astype(np.int64))) for s, e in zip(cut, [*cut[1:], n], strict=True)]


def _text_keys(text: str):
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.conv(F.substring(F.md5(t.cast("binary")), 1, 15), 16, 10).cast("long").alias("k2"), F.octet_length(t).alias("bytes")]


def repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row (k1, k2, all, spans) for each distinct text that has bytes to remove: all of them, or those of the sorted, disjoint
    spans (start, end; end excluded) of its UTF-8 bytes. Texts go by the keys of _text_keys, so ids may be null or repeated;
    they only help to draw one row of each copied text."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), *_text_keys(text)).where(F.col("bytes") >= width)
    keys = staged(d.select("id", "k1", "k2"), "keys")
    texts = staged(keys.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "copied")
    small = F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts
    once = d.join(small, ["k1", "k2"], "left_anti").select("k1", "k2", "text")
    first = staged(d.join(small, ["k1", "k2"]).where("id <=> rep").select("k1", "k2", "text").dropDuplicates(["k1", "k2"]), "first")
    single = once.union(first)

    def cut(batches):
        for b in slices(batches):
            k1, k2, starts, sizes, anchors, several = [], [], [], [], [], []
            for x, y, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for s, n, a, m in stretches(t.encode(), width):
                    k1.append(x), k2.append(y), starts.append(s), sizes.append(n), anchors.append(a), several.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(anchors, pa.int64()), pa.array(several, pa.bool_())], ["k1", "k2", "s", "n", "anchor", "several"])

    segments = staged(single.mapInArrow(cut, "k1 long, k2 long, s int, n int, anchor long, several boolean"), "segments")
    often = segments.groupBy("anchor").agg(F.count("*").alias("times"), F.max("several").alias("m")).where("times > 1 or m").select(F.col("anchor").alias("a"), (F.col("times") > HOT).alias("hot"))
    anchors = staged(often, "anchors")
    wanted = segments.join(anchors, F.col("anchor") == F.col("a")).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "n", "anchor", "hot")).alias("parts"))  # as many as a text is long
    found = wanted.join(single, ["k1", "k2"]).select("k1", "k2", "text", "parts")
    names = ["k1", "k2", "s", "k", "d1", "d2", "content", "weight"]

    def take(batches):
        held: dict[tuple, list] = {}
        size = 0
        for b in slices(batches):
            rows = []
            for k1, k2, t, parts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                data = t.encode()
                for p in parts:
                    content = data[p["s"] : p["s"] + p["n"] + width - 1]
                    for off, n, key in _split(content, p["anchor"], width) if p["hot"] else [(0, p["n"], p["anchor"])]:
                        c = content[off : off + n + width - 1]
                        d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(c), np.int64).tolist()
                        rows.append((k1, k2, p["s"] + off, key, d1, d2))
                        if (h := held.get((key, d1, d2))) is None:
                            held[key, d1, d2] = [c, 1]
                            size += len(c) + 200
                        else:
                            h[1] += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())], names)
            if size > 32_000_000:
                yield from given(held)
                held, size = {}, 0
        yield from given(held)
        held.clear()
        released()

    def given(held):
        items = list(held.items())
        for at in range(0, len(items), 20_000):
            part = items[at : at + 20_000]
            k = list(zip(*(x[0] for x in part), strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), pa.int64()) for _ in range(3)), *(pa.array(c, pa.int64()) for c in k), pa.array([x[1][0] for x in part], pa.binary()), pa.array([x[1][1] for x in part], pa.int64())], names)

    taken = staged(found.mapInArrow(take, "k1 long, k2 long, s long, k long, d1 long, d2 long, content binary, weight long"), "stretches")
    discard(segments, anchors)
    pool = taken.where("content is not null").select("k", "d1", "d2", "content", "weight").repartition(max(1, shuffle_parts(docs.sparkSession)), "k").sortWithinPartitions("k", "d1", "d2")

    def decide(batches):
        rows: list[list] = []
        size = 0
        for b in batches:
            for k, d1, d2, c, w in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and rows[-1][:3] == [k, d1, d2]:
                    rows[-1][4] += w
                    continue
                if size >= SHARD and rows[-1][0] != k:
                    yield from shard(rows)
                    rows, size = [], 0
                rows.append([k, d1, d2, c, w])
                size += len(c)
        if rows:
            yield from shard(rows)
        rows.clear()
        released()

    def shard(rows):
        # windows of different anchors differ, so a shard may hold many
        again = repeated_windows([r[3] for r in rows], [r[4] for r in rows], width)
        out = []
        for r, m in zip(rows, again, strict=True):
            if m.any():
                edge = np.diff(m.astype(np.int8), prepend=0, append=0)
                out.append((r[0], r[1], r[2], [{"f": f, "t": t} for f, t in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.struct([("f", pa.int64()), ("t", pa.int64())])))], ["k", "d1", "d2", "runs"])

    runs = staged(pool.mapInArrow(decide, "k long, d1 long, d2 long, runs array<struct<f: long, t: long>>"), "runs")
    at = taken.where("content is null").select("k1", "k2", "s", "k", "d1", "d2").join(runs, ["k", "d1", "d2"]).select("k1", "k2", "s", F.explode("runs").alias("r"))
    spans = at.groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("s") + F.col("r.f")).alias("start"), (F.col("s") + F.col("r.t") + width - 1).alias("end"))).alias("raw"))

    def merge(batches):
        for b in batches:
            out = []
            for raw in b.column(2).to_pylist():
                now: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in raw):
                    if now and s <= now[-1][1]:
                        now[-1][1] = max(now[-1][1], e)
                    else:
                        now.append([s, e])
                out.append([{"start": s, "end": e} for s, e in now])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["k1", "k2", "spans"])

    parts = spans.mapInArrow(merge, "k1 long, k2 long, spans array<struct<start: long, end: long>>")
    whole = texts.select("k1", "k2", F.lit(True).alias("all"), F.lit(None).cast("array<struct<start: long, end: long>>").alias("spans"))
    out = staged(parts.join(texts, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(False).alias("all"), "spans").union(whole), "repeats")
    discard(keys, texts, first, taken, runs)
    return out


def removed(docs: DataFrame, width: int = WIDTH, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with removed_spans, the byte ranges of the text that repeat (sorted, disjoint), judged on the input as it is.

    A byte goes if a window of `width` bytes over it also starts anywhere else, in the same document or another, copies
    included; rows with null or repeated ids are judged like all others. Null and short texts lose nothing; an empty table gives no rows; a column of that name is replaced.
    """
    docs = docs.drop("removed_spans")
    found = repeats(docs, width, text, id_col).withColumnsRenamed({"k1": "_k1", "k2": "_k2", "all": "_all", "spans": "_spans"})
    rows, size = found.agg(F.count("*"), F.sum(32 + 16 * F.coalesce(F.size("_spans"), F.lit(0)))).first()
    small = rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(F.col(text)).cast("long").alias("end")))
    k1, k2, _ = _text_keys(text)
    out = docs.withColumns({"_k1": k1, "_k2": k2}).join(F.broadcast(found) if small else found, ["_k1", "_k2"], "left")
    spans = F.when(F.col("_all") & (F.octet_length(F.col(text)) >= width), whole).otherwise(F.coalesce("_spans", F.lit([]).cast("array<struct<start: long, end: long>>")))
    return out.withColumn("removed_spans", spans).drop("_k1", "_k2", "_all", "_spans").select(*docs.columns, "removed_spans")


def kept_bytes(data: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = removed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def digest(batches):
        for b in slices(batches):
            out = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (t or "").encode()
                out.append((len(data), sum(s["end"] - s["start"] for s in spans), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text", "removed_spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(h[2 * i + 1 : 2 * i + 400]) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i - p > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
s AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM g GROUP BY doc_id, g),
k AS (SELECT s.doc_id, s.s, s.e, coalesce(lag(s.e) OVER (PARTITION BY s.doc_id ORDER BY s.s), 0) AS p FROM s),
t AS (SELECT k.doc_id, sum(k.e - k.s) AS n_removed, count(*) AS n_spans, string_agg(d.h[2 * k.p + 1 : 2 * k.s], '' ORDER BY k.s) AS head, max(k.e) AS last FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || d.h[2 * coalesce(last, 0) + 1 : 2 * d.n])) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
