"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual subspace codes, asymmetric distances from
look-up tables, exact cosine rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, staged

#: The fit's bounds: least and most vectors sampled for it, lists (one per ROWS_A_LIST vectors), subspaces and codes of each.
SAMPLE, LISTS, ROWS_A_LIST, SUBSPACES, CODES = (8_192, 65_536), (16, 16_384), 512, 8, 256
#: Rows of one block of a list; a longer list is compared block by block.
BLOCK = 1_024


def sample_size(lists: int) -> int:
    """Vectors that a fit of so many lists looks at: eight a list, within the bounds."""
    return min(SAMPLE[1], max(SAMPLE[0], 8 * lists))


def probes(lists: int) -> int:
    """Lists that each vector is entered in, more as lists get more and smaller. Two vectors meet if they share one of them."""
    return 4 + max(0, (lists // 256).bit_length())


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of every row, nearest first."""
    d = (c * c).sum(1) - 2 * (x @ c.T)
    n = min(n, len(c))
    few = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(few, np.argsort(np.take_along_axis(d, few, 1), axis=1, kind="stable"), 1)


class Quantiser:
    """Coarse centroids, and a code book for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse, 1)[:, 0]]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [kmeans(rest[:, cut], min(codes, max(1, len(sample) // 8)), 6) for cut in self.cuts]

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error): the nearest code of each subspace, and the length of what the codes leave."""
        codes = np.stack([nearest(residual[:, cut], book, 1)[:, 0] for cut, book in zip(self.cuts, self.books, strict=True)], 1)
        left = sum(((residual[:, cut] - book[codes[:, m]]) ** 2).sum(1) for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)))
        return codes, np.sqrt(left)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances, queries by coded rows: one table per query and subspace, then look-ups and sums."""
        out = np.zeros((len(residual), len(codes)))
        for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            q = residual[:, cut]
            table = (q * q).sum(1)[:, None] + (book * book).sum(1) - 2 * (q @ book.T)
            out += table[:, codes[:, m]]
        return out


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out / np.sqrt((out * out).sum(1))[:, None]


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec: str = "embedding", id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept. Linked: cosine of at least `least` under one label.

    Equal vectors of a label are one class and are counted, not compared. The index is fitted on a sample of
    bounded size and holds every class, in the lists of its nearest centroids; two classes are compared in the first list that they
    share, if their asymmetric distance allows the cosine (the codes' own error is added, so this loses nothing). Pairs that
    share no list are missed: the recall is measured in the tests. A long list is cut into blocks that are compared two by
    two. Pairs are counted where they are found; only counts and a spanning forest leave a task.
    Vectors that are null, empty, zero or hold null or non-finite components, and those without label, link with nothing, nor
    do vectors of different lengths. Ids only name components, by the smallest of their rows: rows that share an id or
    have none are judged by their vectors, and a component is null only if no row of it has an id. An empty table gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    all_ = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    classes = staged(all_.where(good).groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("size", F.size("v")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    n, dims = classes.agg(F.count("*"), F.max("size")).first()
    own = all_.withColumn("good", good)
    back = own.join(classes.select(F.col("label").alias("l"), F.col("v").alias("w"), "rep", "low", "copies"), F.col("good") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left").select("id", "rep", F.coalesce("low", "id").alias("low"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("same"))
    if n:
        lists = min(LISTS[1], max(LISTS[0], n // ROWS_A_LIST))
        sample = classes.orderBy(F.xxhash64("v")).limit(sample_size(lists)).select("v").toArrow().column("v").combine_chunks()
        q = Quantiser(_unit(sample, dims), lists)
        found = staged(_compare(classes, q, dims, least), "links")
        counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
        comps = components(found.where("b is not null").select("a", "b"))
    else:
        counts = spark.createDataFrame([], "a long, links long")
        comps = spark.createDataFrame([], "id long, component long")
    comps = staged(comps, "components")
    least = comps.join(classes.select("rep", "low"), F.col("id") == F.col("rep")).groupBy("component").agg(F.min("low").alias("least"))
    comps = comps.join(least, "component").select(F.col("id").alias("c"), "least")
    byrep = classes.select("rep").join(counts, F.col("rep") == F.col("a"), "left").join(comps, F.col("rep") == F.col("c"), "left").where("links is not null or c is not null").select(F.col("rep").alias("r"), "links", F.col("c").isNotNull().alias("on"), "least")
    out = back.join(byrep, F.col("rep") == F.col("r"), "left")
    component = F.when(F.col("on"), F.col("least")).otherwise(F.col("low"))
    return out.select(F.col("id").alias("vec_id"), (F.col("same") + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _compare(classes: DataFrame, q: Quantiser, dims: int, least: float) -> DataFrame:
    """Rows (a, null, n): n links of class a, copies included; rows (a, b, null): an edge of a spanning forest of a comparison."""

    def enter(batches):
        for b in batches:
            lists = nearest(_unit(b.column(3), dims), q.coarse, probes(len(q.coarse)))
            lists.sort(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists.tolist(), pa.list_(pa.int32()))], ["label", "rep", "copies", "v", "size", "lists"])

    entered = classes.select("label", "rep", "copies", "v", "size").mapInArrow(enter, "label string, rep long, copies long, v array<double>, size int, lists array<int>")
    entries = staged(entered, "entries").withColumn("list", F.explode("lists"))
    blocks = entries.groupBy("label", "size", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = entries.join(blocks, ["label", "size", "list"])
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other", "blocks")
    reach = np.sqrt(max(0.0, 2 - 2 * least))

    def run(key, table):
        reps, copies = (table.column(c).to_numpy() for c in ("rep", "copies"))
        x = _unit(table.column("v").combine_chunks(), dims)
        lists = np.array(table.column("lists").to_pylist())
        here, lo, hi = key[2].as_py(), key[3].as_py(), key[4].as_py()
        mine = table.column("mine").to_numpy()
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        residual = x - q.coarse[here]
        codes, error = q.code(residual[right])
        near = q.distances(residual[left], codes) <= (reach + error + 1e-6) ** 2
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        if len(i):
            # in the first list that both are in, and nowhere else
            shared = (lists[i][:, :, None] == lists[j][:, None, :]).any(2)
            first = np.where(shared.any(1), lists[i][np.arange(len(i)), shared.argmax(1)], -1) == here
            i, j = i[first], j[first]
            i, j = (z[np.einsum("ij,ij->i", x[i], x[j]) >= least] for z in (i, j))
        n = np.zeros(len(x), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        on = np.flatnonzero(n)
        a, b = _forest(len(x), i, j)
        return pa.table({"a": pa.array(np.concatenate([reps[on], reps[a]]), pa.int64()), "b": pa.array([None] * len(on) + reps[b].tolist(), pa.int64()), "n": pa.array(n[on].tolist() + [None] * len(a), pa.int64())})

    return rows.groupBy("label", "size", "list", "lo", "hi").applyInArrow(run, "a long, b long, n long")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the pairs join: each row to the lowest of its component."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    at = np.flatnonzero(low != np.arange(n))
    return at, low[at]


def op4_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
