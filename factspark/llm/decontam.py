"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of consecutive benchmark words. A shift table over blocks of two or three words tells how far the search may skip;
where it may not, a bucket of patterns by the hash of their last block is compared word by word. Words are numbered by the
benchmark's own vocabulary, so equal numbers are equal words. The search runs over many stretches of a batch at once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, slices, staged

#: A-Z to a-z; every byte that is no letter, digit or part of a non-ASCII character to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: UTF-8 bytes of benchmark text that go to the workers at once; a larger benchmark is searched for in several such blocks.
BLOCK_BYTES = 32_000_000
_STRETCH = 512


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """Patterns of one length m over word numbers (1 and up; 0 is a word that no pattern has).

    The shift table has about 64 places a pattern, a byte each, and from 20,000 patterns on a block is three words, so that the
    share of positions that can be skipped doesn't fall as patterns grow in number.
    """

    def __init__(self, patterns: np.ndarray, table_bits: int | None = None):
        self.m = patterns.shape[1]
        self.block = min(2 if len(patterns) < 20_000 else 3, self.m)
        bits = table_bits or min(27, max(16, (64 * len(patterns)).bit_length()))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.m - self.block + 1, np.uint8 if self.m < 256 else np.int64)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, (self._hash(patterns, end) >> self.down).astype(np.int64), self.m - 1 - end)
        last = self._hash(patterns, self.m - 1)
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.suffix, self.patterns = last[self.order], patterns.astype(np.int32)[self.order]

    def _hash(self, w: np.ndarray, end) -> np.ndarray:
        """Of the block that ends at column `end` of rows of words, or at the places `end` of a row."""
        h = np.uint64(0)
        for k in range(self.block):
            h = (h ^ (w[..., end - k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return h * np.uint64(0xC2B2AE3D27D4EB4F)

    def search(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, pattern) of every occurrence in w."""
        n = len(w)
        at = np.arange(self.m - 1, n, _STRETCH)
        stop = np.minimum(at + _STRETCH, n)
        ends, found = [], []
        while len(at):
            h = self._hash(w, at)
            step = self.shift[(h >> self.down).astype(np.int64)].astype(np.int64)
            if (hit := step == 0).any():
                pos, key = at[hit], h[hit]
                first = np.searchsorted(self.suffix, key)
                size = np.searchsorted(self.suffix, key, "right") - first
                pos = np.repeat(pos, size)
                pattern = np.arange(len(pos)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                for k in range(self.m - 1, -1, -1):
                    same = w[pos - (self.m - 1 - k)] == self.patterns[pattern, k]
                    pos, pattern = pos[same], pattern[same]
                ends.append(pos)
                found.append(self.order[pattern])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return (np.concatenate(ends), np.concatenate(found)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Benchmark:
    """Windows of `window` consecutive words of every item; an item of fewer words, but not none, is one window."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = 10):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        by_length: dict[int, list] = {}
        for item, text in items:
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words((text or "").encode())], np.int32)
            if m := min(window, len(w)):
                rows = np.lib.stride_tricks.sliding_window_view(w, m)
                by_length.setdefault(m, []).append((rows, np.full(len(rows), -1 if item is None else number[str(item)], np.int32)))
        #: for each length: the search, where each pattern's items begin, and the items of all patterns
        self.searches = []
        for m, found in sorted(by_length.items()):
            rows, owner = np.concatenate([r for r, _ in found]), np.concatenate([o for _, o in found])
            patterns, of = np.unique(np.ascontiguousarray(rows).view(f"V{4 * m}").ravel(), return_inverse=True)
            of, owner = np.unique(np.stack([of, owner], 1), axis=0).T
            self.searches.append((WuManber(patterns.view(np.int32).reshape(-1, m)), np.searchsorted(of, np.arange(len(patterns) + 1)), owner))

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, the word ranges that occurrences cover (merged, end excluded), the items."""
        numbers, counts = [], []
        get = self.vocabulary.get
        for t in texts:
            w = words(t)
            counts.append(len(w))
            numbers.append(np.fromiter((get(x, 0) for x in w), np.int32, len(w)))
            numbers.append(np.zeros(1, np.int32))
        out = [(n, [], set()) for n in counts]
        all_ = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        starts = np.cumsum([0, *(n + 1 for n in counts)])
        cover = np.zeros(len(all_) + 1, np.int32)
        for s, first, owner in self.searches:
            ends, found = s.search(all_)
            if not len(ends):
                continue
            np.add.at(cover, ends - s.m + 1, 1)
            np.add.at(cover, ends + 1, -1)
            doc = np.searchsorted(starts, ends, "right") - 1
            for d, p in np.unique(np.stack([doc, found], 1), axis=0):
                out[d][2].update(self.names[i] for i in owner[first[p] : first[p + 1]].tolist() if i >= 0)
        on = np.cumsum(cover) > 0
        edge = np.diff(on.astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(starts, first, "right") - 1
        for d, a, b in zip(doc.tolist(), first.tolist(), end.tolist(), strict=True):
            out[d][1].append((a - int(starts[d]), b - int(starts[d])))
        return out


def _merged(a: list, b: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted([*map(tuple, a), *map(tuple, b)]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """docs with n_words, hit_spans (word ranges inside any occurrence of a window, merged, end excluded) and hit_items (ids as
    sorted strings).

    The benchmark goes to the workers as one broadcast and is built once a worker. One of more than BLOCK_BYTES is cut into blocks
    by the hash of its texts, and each block is a pass of its own whose result is staged in place of the one before: memory is that of a block, whatever the
    benchmark's size. Null texts and texts without words have no words and no hits, in either table; an item without id still
    marks words; repeated items count once; an empty benchmark hits nothing. Columns of those names are replaced, all others kept.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit([]).cast("array<struct<start: long, end: long>>").alias("hit_spans"), F.lit([]).cast("array<string>").alias("hit_items"))
    names = out.columns
    at = names.index(text)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out_of_pass: DataFrame | None = None
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else bench
        items = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.toLocalIterator()])

        def run(batches, items=items, key=uuid.uuid4().hex):
            b = _built(key, items, window)
            for rows in slices(batches):
                found = b.scan([x or b"" for x in rows.column(at).cast(pa.binary()).to_pylist()])
                spans, ids = ([x or [] for x in rows.column(c).to_pylist()] for c in (names.index("hit_spans"), names.index("hit_items")))
                new = {
                    "n_words": pa.array([x[0] for x in found], pa.int64()),
                    "hit_spans": pa.array([_merged([(y["start"], y["end"]) for y in old], x[1]) for old, x in zip(spans, found, strict=True)], spans_type),
                    "hit_items": pa.array([sorted({*old, *x[2]}) for old, x in zip(ids, found, strict=True)], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([new.get(n, rows.column(i)) for i, n in enumerate(names)], names)

        out = out.mapInArrow(run, out.schema)
        if blocks > 1:
            out, before = staged(out, "leaks"), out_of_pass
            out_of_pass = out
            if before is not None:
                discard(before)
            items.unpersist()
    return out


_last: dict[str, Benchmark] = {}


def _built(key: str, items, window: int) -> Benchmark:
    """The benchmark of a broadcast, built once in each worker; a worker keeps the last one."""
    if key not in _last:
        _last.clear()
        _last[key] = Benchmark(items.value, window)
    return _last[key]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT dw.doc_id, dw.i, dw.m, p.item_id FROM dw JOIN p ON dw.t = p.t AND dw.m = p.m),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
