import zlib

from pyspark.sql import functions as F

from factspark.llm.shards import op2_histogram_shards, shard, splitters, write_shards


def sizes(df):
    return df.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("b"), F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("k")).collect()


def test_near_equal_gapless_and_whole(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 7).cast("int")).alias("text"), F.lit("x").alias("slot"))
    out = shard(d, 16, block_rows=300)
    got = sizes(out)
    assert len(got) == 16 and all(r.n == r.m + 1 == r.k for r in got)
    assert max(r.b for r in got) <= 1.03 * min(r.b for r in got)
    assert out.select("doc_id").distinct().count() == 20_000


def test_a_hot_text_is_cut_by_id(spark):
    d = spark.range(9_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("hot "), 40)).otherwise(F.repeat(F.col("id").cast("string"), 30)).alias("text"))
    got = sizes(shard(d, 20))
    assert len(got) == 20 and max(r.b for r in got) <= 1.1 * min(r.b for r in got)


def test_odd_rows(spark):
    d = spark.createDataFrame([(None, None), (1, None), (1, None), (2, ""), (3, "x" * 100_000), (-5, "a")], "doc_id long, text string")
    out = shard(d, 3).collect()
    assert len(out) == 6 and {r.shard for r in out} <= {0, 1, 2}
    assert shard(d.limit(0), 3).count() == 0


def test_splitters_at_the_ends_of_the_key(spark):
    keys = spark.createDataFrame([(-(2**63), -(2**63), 10), (2**63 - 1, 2**63 - 1, 10), (0, 0, 10), (0, 1, 10)], "k0 long, k1 long, size long")
    cuts, total = splitters(keys, 4, 0.01)
    assert total == 40 and cuts == sorted(cuts) and len(cuts) == 3


def test_written_shards(spark, tmp_path):
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    write_shards(shard(d, 4), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("shard=*"))) == 4 and spark.read.parquet(str(tmp_path / "s")).count() == 100


def test_the_query_row_by_row(spark, tmp_path):
    """Sizes, checksums, slots, equal bytes and groups of equal texts, from the rows in plain Python."""
    rows = [(i, f"text {i} " * (i % 40)) for i in range(4_000)] + [(i, "copied " * 20) for i in range(4_000, 5_500)] + [(5_500, None), (5_501, ""), (5_502, "é" * 60_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op2_histogram_shards(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    held, slots, where = [0] * 40, [[] for _ in range(40)], {}
    for i, text in rows:
        data, r = (text or "").encode(), got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where.setdefault(data, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    # the large row is longer than a shard, so its neighbours may lie a row off; the others are near the mean
    mean, large = sum(held) / 40, got[5_502].shard
    assert all(abs(b - mean) <= 0.03 * mean + 400 for k, b in enumerate(held) if abs(k - large) > 3), held
    # copies of a text lie in one run of shards: 210,000 of its bytes fill a few, all else is cut by no boundary
    assert all(max(w) - min(w) + 1 == len(w) for w in where.values()) and sum(len(w) > 1 for w in where.values()) <= 39


def test_rows_alike_in_text_and_id_are_cut(spark):
    hot = spark.range(0, 50_000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    docs = hot.union(spark.range(0, 50_000, 1, 4).select("id", F.concat(F.lit("text "), F.lpad("id", 8, "0"))))
    got = shard(docs, 10).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 16).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    total = sum(r.bytes for r in got)
    assert len(got) == 10 and sum(r.n for r in got) == 100_000
    assert all(abs(r.bytes - total / 10) <= 0.02 * total / 10 and r.n == r.slots == r.last + 1 for r in got)
