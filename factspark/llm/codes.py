"""Vector code compression: product codes by exact integer k-means, each part's nearest entry found in a ball-bounded
vantage-point tree over the entries of its position."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a numpy batch; bits of a limb of a sum; label sums that are broadcast at most, and copies of each beyond that.
BATCH, LIMB, BROADCAST_LABELS, SALTS = 4_096, 40, 1_000_000, 64
_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def fits_long(top: int, width: int, entries: int) -> bool:
    """Whether 64-bit integers hold a part's squared distances with an entry's number in the low bits; else numpy holds Python integers."""
    return (2 * top) ** 2 * max(1, width) * entries < 1 << 62


class VantageTrees:
    """One tree per part position over the entries of its codebook, searched for all parts of a batch level by level.

    A node is an entry, and two children, each with the least and the largest distance of its entries from the node's. All
    radii are integers rounded outwards, a child is visited unless its bound is larger than the best distance so far (so equal
    ones are), and candidates are told apart by whole squared distances, then by number: results are exact, ties included.
    """

    def __init__(self, books: list[np.ndarray]):
        self.entries = max(1, max((len(b) for b in books), default=1))
        self.points = np.concatenate(books) if books else np.zeros((0, 0), np.int64)
        nodes: list[list[int]] = []
        self.number = np.concatenate([np.arange(len(b)) for b in books]) if books else np.zeros(0, np.int64)

        def build(ids: list[int]) -> int:
            me, at = ids[0], len(nodes)
            nodes.append([me, -1, 0, 0, -1, 0, 0])
            if rest := [(int(((self.points[i] - self.points[me]) ** 2).sum()), i) for i in ids[1:]]:
                rest.sort()
                half = (len(rest) + 1) // 2
                for child, side in ((1, rest[:half]), (4, rest[half:])):
                    if side:
                        nodes[at][child : child + 3] = [build([i for _, i in side]), math.isqrt(side[0][0]), math.isqrt(side[-1][0]) + 1]
            return at

        ends = np.cumsum([len(b) for b in books]).tolist()
        self.roots = np.array([build(list(range(end - len(b), end))) for b, end in zip(books, ends, strict=True)])
        # radii as large as the points' own integers
        self.nodes = np.array(nodes, self.points.dtype)
        self.entry, self.near, self.far = (self.nodes[:, c].astype(np.int64) for c in (0, 1, 4))

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers, squared distances, entries looked at) of the nearest entries of x[row, part, component]."""
        n, parts = x.shape[:2]
        flat, k = x.reshape(n * parts, -1), self.entries
        q, node = np.arange(n * parts), np.tile(self.roots, n)
        best, seen = None, 0
        while len(q):
            seen += len(q)
            away = flat[q] - self.points[self.entry[node]]
            d = (away * away).sum(1)
            key = d * k + self.number[self.entry[node]]
            if best is None:
                best = key
            else:
                np.minimum.at(best, q, key)
            root = _isqrt(d) if d.dtype == object else np.sqrt(d.astype(np.float64)).astype(np.int64)
            low, high, limit = root - 1, root + 2, best[q] // k
            more = []
            for child, at in ((self.near, 1), (self.far, 4)):
                bound = np.maximum(np.maximum(low - self.nodes[node, at + 2], self.nodes[node, at + 1] - high), 0)
                go = np.flatnonzero((child[node] >= 0) & (bound * bound <= limit).astype(bool))
                more.append((q[go], child[node[go]]))
            q, node = (np.concatenate(c) for c in zip(*more, strict=True))
        best = np.zeros(0, np.int64) if best is None else best
        return (best % k).astype(np.int64).reshape(n, parts), (best // k).reshape(n, parts), seen


@dataclass
class Codebooks:
    """entries[part][entry] are the components of an entry, as Python integers."""

    entries: list[list[list[int]]]
    scale: int
    dims: int
    top: int

    @property
    def width(self) -> int:
        return self.dims // len(self.entries)

    @property
    def dtype(self):
        return np.int64 if fits_long(self.top, self.width, max(1, len(self.entries[0]))) else object

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.entries for e in part for c in e).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The components that a code stands for."""
        return [c for p, part in enumerate(self.entries) for c in part[int(code[2 * p : 2 * p + 2], 16)]]

    def trees(self) -> VantageTrees:
        return VantageTrees([np.array(e, self.dtype).reshape(len(e), self.width) for e in self.entries])

    def parts(self, column: pa.Array) -> np.ndarray:
        """floor(scale * x) of every component, cut into parts; short vectors are filled up with zeros."""
        return integers(column, self.dims, self.scale, self.dtype).reshape(len(column), len(self.entries), self.width)


def integers(column: pa.Array, dims: int, scale: int, dtype=np.int64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if dtype is object:
        values = np.array([scale * int(v) if abs(v) > 1e100 else math.floor(scale * v) for v in values.tolist()] + [0], object)[:-1]
    else:
        values = np.floor(scale * values).astype(np.int64)
    sizes = column.value_lengths().to_numpy()
    if (sizes == dims).all():
        return values.reshape(len(column), dims)
    out = np.zeros((len(column), dims), dtype)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def usable(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """(id, label, v, size, top) of the rows whose vector is not null and whose components are all there and finite."""

    def run(batches):
        for b in slices(batches, BATCH):
            v = b.column(2)
            v = v.filter(pa.array(v.is_valid()))
            b = b.filter(b.column(2).is_valid())
            values = v.flatten()
            x = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            sizes = v.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(v)), sizes)
            good = np.ones(len(v), bool)
            good[row[~np.isfinite(x)]] = False
            top = np.zeros(len(v))
            np.maximum.at(top, row, np.abs(np.where(np.isfinite(x), x, 0)))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), v, pa.array(sizes, pa.int32()), pa.array(top)], ["id", "label", "v", "size", "top"])
            yield out.filter(pa.array(good))

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, label string, v array<double>, size int, top double")


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all rows of `usable`, or None if there are none: the first entries by id, then `rounds` exact rounds.

    A round reads every row once; a task sends `entries` sums and counts per part, and entries * dimensions sums come to the
    driver. Sums travel as limbs of 40 bits, so they are exact whatever the components are.
    """
    n, size, top = rows.agg(F.count("*"), F.max("size"), F.max("top")).first()
    if not n:
        return None
    dims = -(-size // parts) * parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    limit = scale * (int(top) + 1)
    start = integers(first, dims, scale, object).reshape(len(first), parts, dims // parts)
    books = Codebooks([start[:, p].tolist() for p in range(parts)], scale, dims, limit)
    for _ in range(rounds):
        books = _refined(rows, books)
    return books


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    parts, k = len(books.entries), len(books.entries[0])

    def sums(batches):
        trees, totals = books.trees(), {}
        for b in slices(batches, BATCH):
            if not b.num_rows:
                continue
            x = books.parts(b.column(0))
            group = (trees.search(x)[0] + np.arange(parts) * k).ravel()
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            counts = np.diff(np.append(starts, len(order)))
            added = np.add.reduceat(x.reshape(len(group), -1)[order], starts, axis=0) if books.width else np.zeros((len(starts), 0), np.int64)
            for g, c, s in zip(group[order][starts].tolist(), counts.tolist(), added.tolist(), strict=True):
                old = totals.get(g)
                totals[g] = [c, *s] if old is None else [a + b for a, b in zip(old, [c, *s], strict=True)]
        out = [(g, pos, limb, v) for g, values in totals.items() for pos, total in enumerate(values) for limb, v in enumerate(_limbs(total))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["g", "pos", "limb", "v"])

    found = rows.select("v").mapInArrow(sums, "g int, pos int, limb int, v long").groupBy("g", "pos", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    totals: dict[int, list[int]] = {}
    for r in found:
        totals.setdefault(r["g"], [0] * (books.width + 1))[r["pos"]] += int(r["v"]) << (LIMB * r["limb"])
    entries = [[[s // t[0] for s in t[1:]] if (t := totals.get(p * k + e)) else old for e, old in enumerate(part)] for p, part in enumerate(books.entries)]
    return Codebooks(entries, books.scale, books.dims, books.top)


def _limbs(v: int) -> list[int]:
    out, half = [], 1 << (LIMB - 1)
    while not -half <= v < half:
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def encode(rows: DataFrame, books: Codebooks | None) -> DataFrame:
    """(id, label, code, error): two hex digits a part; error is null where it is no 64-bit integer."""

    def run(batches):
        trees = books.trees()
        for b in slices(batches, BATCH):
            numbers, d, _ = trees.search(books.parts(b.column(2)))
            error = [e if e < 1 << 63 else None for e in d.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bytes(r).hex() for r in numbers.astype(np.uint8)], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    schema = "id long, label string, code string, error long"
    return rows.select("id", "label", "v").mapInArrow(run, schema) if books else rows.sparkSession.createDataFrame([], schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec: str = "embedding", id_col: str = "vec_id", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(a row per usable vector: vec_id, label, code, error, label_error; the codebooks).

    Rows whose vector is null or holds a null or non-finite component are dropped; any other row is kept, repeated rows, ids
    and null ids too (a null id sorts last among the first entries, rows of one id by their vectors). Vectors whose length
    isn't that of the longest, rounded up to a multiple of `parts`, are filled up with zeros. An error that is no 64-bit
    integer is null, and so is then its label's sum. With fewer rows than entries a codebook has that many entries; an empty
    table gives no rows and no codebooks. Other columns are ignored, whatever their names. entries: 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so 1 to 256 entries")
    rows = staged(usable(vectors, vec, id_col, label), "vectors")
    books = fit(rows, parts, entries, rounds, scale)
    coded = staged(encode(rows, books), "codes")
    known = F.count("error") == F.count("*")
    sums = coded.groupBy("label").agg(F.when(known, F.try_sum("error")).alias("label_error")).withColumnRenamed("label", "_label")
    if sums.count() <= BROADCAST_LABELS:
        sums, on = F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))
    else:  # a label may hold a third of all rows: its rows are dealt over SALTS keys
        sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        coded = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        on = F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt"))
    return coded.join(sums, on).select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _oracle() -> str:
    """SQL has no loops over rounds, so each round is two tables."""
    sql = f"""
WITH g AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM g, range({PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p WHERE vec_id IN (SELECT vec_id FROM g ORDER BY vec_id LIMIT {ENTRIES})),"""
    for r in range(ROUNDS + 1):
        sql += f"""
k{r} AS MATERIALIZED (SELECT vec_id, label, p.part, x, min(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + entry) AS k FROM p JOIN b{r} USING (part) GROUP BY ALL),"""
        if r < ROUNDS:
            sql += f"""
s{r} AS (SELECT part, k % {ENTRIES} AS entry, pos, sum(c) AS s, count(*) AS n FROM (SELECT part, k, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM k{r}) GROUP BY ALL),
n{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS e FROM s{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN n{r} USING (part, entry)),"""
    return (
        sql
        + f"""
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', CAST(k % {ENTRIES} AS INT)), '' ORDER BY part) AS code, CAST(sum(k // {ENTRIES}) AS BIGINT) AS error FROM k{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""
    )


ORACLE = _oracle()
