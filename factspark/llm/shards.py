"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until every splitter is good enough, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import shuffle_parts, staged

FIRST_BITS, MORE_BITS = 12, 8


LOW, HIGH = -(2**63), 2**63 - 1
KEYS = ("k0", "k1", "k2")


def sort_key(text: str = "text", id_col: str = "doc_id", row: str = "_row") -> list[Column]:
    """Rows sort by the hash of their text, then by id, then by their number: copies of a text stand together, and a hot text, or a
    hot text under one id, can still be cut."""
    return [F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)), F.col(row).cast("long")]


def splitters(keys: DataFrame, n_shards: int, tolerance: float) -> tuple[list[tuple[int, ...]], int]:
    """n_shards - 1 boundaries (k0, k1, k2) over keys (k0, k1, k2, size), and the total size.

    A shard holds the rows from one boundary up to below the next. Probes are evenly spaced values of a key part: FIRST_BITS of
    k0 first, then MORE_BITS more within each gap that holds an unmet target, then of k1 within a single k0 and of k2 within a
    single k0 and k1. Each round counts the exact bytes below every probe over all partitions; at most n_shards * 2**MORE_BITS
    sums come to the driver. A target is met at a probe whose bytes are within tolerance shards of it, else at the nearest row.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / n_shards
    found: dict[int, tuple[int, ...]] = {}
    Gap = tuple[tuple[int, ...], int, int]  # values of the parts before, first value, bits of its width
    gaps: dict[Gap, list[int]] = {((), LOW, 64): list(range(1, n_shards))}
    below: dict[Gap, int] = {((), LOW, 64): 0}
    while gaps:
        ahead: dict[Gap, list[int]] = {}
        for part, bits in sorted({(len(before), bits) for before, _, bits in gaps}):
            here = {g: t for g, t in gaps.items() if (len(g[0]), g[2]) == (part, bits)}
            step = max(0, bits - (FIRST_BITS if bits == 64 else MORE_BITS))
            rows = keys if not part and bits == 64 else keys.where(_within(part, bits, list(here)))
            sums: dict[tuple[tuple[int, ...], int], list[tuple[int, int]]] = {}
            for r in rows.groupBy(*KEYS[:part], F.shiftright(KEYS[part], step).alias("d")).agg(F.sum("size").alias("s")).collect():
                d = r["d"] << step
                sums.setdefault((tuple(r)[:part], d >> bits << bits if bits < 64 else LOW), []).append((d, r["s"]))
            for gap, targets in here.items():
                at, todo = below[gap], list(targets)
                for d, s in sorted(sums.get(gap[:2], [])):
                    while todo and todo[0] * total / n_shards < at + s:
                        goal, t = todo[0] * total / n_shards, todo.pop(0)
                        low_off, high_off = goal - at, at + s - goal
                        if min(low_off, high_off) <= slack or part == len(KEYS) - 1 and not step:
                            found[t] = _boundary(gap[0], d if low_off <= high_off else d + (1 << step))
                        else:
                            inner = (gap[0], d, step) if step else ((*gap[0], d), LOW, 64)
                            ahead.setdefault(inner, []).append(t)
                            below[inner] = at
                    at += s
                for t in todo:
                    found[t] = _boundary(gap[0], HIGH + 1)
        gaps = ahead
    out = [found[t] for t in sorted(found)]
    return [max(out[: i + 1]) for i in range(len(out))], total


def _boundary(before: tuple[int, ...], v: int) -> tuple[int, ...]:
    """The least key from a value on, under values of the parts before."""
    while v > HIGH and before:
        v, before = before[-1] + 1, before[:-1]
    return (*before, v, *[LOW] * len(KEYS))[: len(KEYS)] if v <= HIGH else (HIGH,) * len(KEYS)


def _within(part: int, bits: int, gaps: list[tuple[tuple[int, ...], int, int]]) -> Column:
    """Rows that may lie in one of the gaps; what lies beside them is told apart by its first value."""
    inside = F.lit(True)
    for i in range(part):
        inside &= F.col(KEYS[i]).isin(sorted({g[0][i] for g in gaps}))
    return inside if bits == 64 else inside & F.shiftright(KEYS[part], bits).isin(sorted({g[1] >> bits for g in gaps}))


def shard(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.01, text: str = "text", id_col: str = "doc_id", block_rows: int = 100_000) -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard), after one exchange of the rows.

    Sizes (UTF-8 bytes of the text plus 16) are near equal: a boundary is off by at most tolerance of a shard, or by one row
    where rows are larger than that. Copies of a text stay together unless a boundary must cut them. A null text has size 16;
    a null id sorts first; rows alike in text and id are cut by their number in the written table; an empty table gives no
    rows. Other columns are kept, except that columns named shard or slot are replaced.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.drop("shard", "slot")
    given = docs.columns
    docs = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    k0, k1, k2 = sort_key(text, id_col)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16
    keys = staged(docs.select(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), size.alias("size")), "keys")
    rows = keys.count()
    cuts, _ = splitters(keys, n_shards, tolerance)
    # boundaries by the first bits of k0: 2**FIRST_BITS rows at most, so a row looks at the few boundaries in its own range
    shift = 64 - FIRST_BITS
    half = 1 << (FIRST_BITS - 1)
    table = [(d, sum((c[0] >> shift) < d for c in cuts), [c for c in cuts if c[0] >> shift == d]) for d in range(-half, half)]
    cut_table = F.broadcast(spark.createDataFrame(table, "d long, base int, cuts array<struct<k0: long, k1: long, k2: long>>"))
    blocks = max(1, -(-rows // (n_shards * block_rows)))

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_d", F.shiftright("_k0", shift)).join(cut_table, F.col("_d") == cut_table["d"])
        inside = F.size(F.filter("cuts", lambda c: c <= F.struct(F.col("_k0").alias("k0"), F.col("_k1").alias("k1"), F.col("_row").alias("k2"))))
        return df.withColumn("shard", F.col("base") + inside).withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")).drop("d", "base", "cuts", "_d")

    counts = placed(keys.select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), F.col("k2").alias("_row"))).groupBy("shard", "_block").count()
    ahead = F.sum("count").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("shard").alias("_s"), F.col("_block").alias("_b"), F.coalesce(ahead, F.lit(0)).alias("_start"))
    # one exchange of the rows, by shard and block; a block's rows are numbered within it, after the rows of the blocks before
    moved = placed(docs.withColumns({"_k0": k0, "_k1": k1})).repartition(max(shuffle_parts(spark), 1), "shard", "_block")
    number = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_k0", "_k1", "_row"))
    out = moved.withColumn("_n", number).join(starts, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return out.select(*(F.col(f"`{c}`") for c in given), "shard", (F.col("_start") + F.col("_n") - 1).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard."""
    sharded.write.partitionBy("shard").parquet(path)


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int"),
        F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
