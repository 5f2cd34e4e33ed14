"""Source trees as rows: reading, quotas, policies, diagnostics, manifests, duplicates, profile signals, diffs.

files: rel_path, size, text (or content), ord (the walk order).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


@dataclass(frozen=True)
class Quotas:
    max_files: int = 50_000
    max_total_bytes: int = 5 * 1024**3
    max_file_bytes: int = 50 * 1024**2
    max_depth: int = 64


#: For tables that are taken whole: no file is left out for its size or for those before it.
WHOLE = Quotas(*[2**63 - 1] * 4)


def read_tree(spark: SparkSession, root: str, max_file_bytes: int | None = None) -> DataFrame:
    """rel_path, size, mtime, content of every file below root; size filters reach the scan."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if max_file_bytes is not None:
        df = df.where(F.col("length") <= max_file_bytes)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return df.select(F.substring(path, F.length(base) + 2, F.length(path)).alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def decoded(content: Column, most: int) -> tuple[Column, Column]:
    """(text, encoding) of the first `most` bytes: UTF-8 where they are valid, else Latin-1."""
    part = F.substring(content, 1, most)
    text = F.try_validate_utf8(part.cast("string"))
    return F.coalesce(text, F.decode(part, "ISO-8859-1")), F.when(text.isNotNull(), "utf-8").otherwise("latin-1")


def is_binary(content: Column, head: int = 4096) -> Column:
    """Whether a NUL byte is among the first `head` bytes."""
    return F.contains(F.decode(F.substring(content, 1, head), "ISO-8859-1"), F.lit("\0"))


def classified(files: DataFrame, q: Quotas = Quotas()) -> DataFrame:
    return files.withColumns({"language": F.when(F.col("size") > q.max_file_bytes, "other").otherwise(S.language(F.col("rel_path"))), "parse_policy": S.parse_policy(F.col("rel_path"), F.col("size"), q.max_file_bytes)})


def _range_of(value: Column, ends: list[str]) -> Column:
    """How many of the sorted ends are at or below a value: first of every step-th, then of those after the last of these."""
    step = max(1, round((len(ends) + 1) ** 0.5))
    texts = lambda part: F.array(*map(F.lit, part)).cast("array<string>")
    below = lambda part: F.size(F.filter(part, lambda e: e <= value))
    coarse = ends[step - 1 :: step]
    fine = F.array(*(texts(ends[i * step : (i + 1) * step - 1]) for i in range(len(coarse) + 1)))
    at = below(texts(coarse))
    return at * step + below(F.element_at(fine, at + 1))


def running_totals(df: DataFrame, order: str, values: dict[str, Column], ranges: int = 256) -> DataFrame:
    """df with the running sums of values in the order of a string column: ranges of the order are summed first, then a window inside
    each goes on from what lies ahead, so that no task sorts all rows, whatever prefix they share. Ranges end at paths drawn by hash
    (16 a range, which only balances tasks: the sums are exact). Rows alike in order have one sum; null comes first."""
    drawn = sorted(r[0] for r in df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(16 * ranges).collect())
    rows = df.withColumns({"_range": _range_of(F.col(order), drawn[16::16])} | {f"_of_{k}": v for k, v in values.items()})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(*(F.sum(f"_of_{k}").alias(f"_sum_{k}") for k in values))
    ahead = sums.select("_range", *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_ahead_{k}") for k in values))
    inside = Window.partitionBy("_range").orderBy(order)
    # a row a range
    rows = rows.join(F.broadcast(ahead), "_range").withColumns({k: F.col(f"_ahead_{k}") + F.sum(f"_of_{k}").over(inside) for k in values})
    return rows.drop("_range", *(f"_{p}_{k}" for p in ("of", "ahead") for k in values))


def within_quotas(files: DataFrame, q: Quotas) -> DataFrame:
    """The walk's files with n and total (their number and bytes so far, in rel_path order) and status: kept, MAX_FILES or MAX_TOTAL_BYTES."""
    rows = running_totals(files, "rel_path", {"n": F.lit(1).cast("long"), "total": F.col("size")})
    return rows.withColumn("status", F.when(F.col("n") > q.max_files, "MAX_FILES").when(F.col("total") > q.max_total_bytes, "MAX_TOTAL_BYTES").otherwise("kept"))


def diagnostics(files: DataFrame, q: Quotas) -> DataFrame:
    """rel_path, code: one row per complaint of a file."""
    path, size = F.col("rel_path"), F.col("size")
    bundle = S.extension(path).isin(*S.LANGUAGES["javascript"]) & (S.parse_policy(path, size, q.max_file_bytes) == "skip_size")
    code = F.when(S.depth(path) > q.max_depth, "MAX_DEPTH").when(size > q.max_file_bytes, "FILE_TOO_LARGE").when(bundle, "JS_BUNDLE_SKIPPED")
    return files.select("rel_path", code.alias("code")).where("code is not null")


def manifest_hashes(files: DataFrame) -> DataFrame:
    """One row: n_files, manifest_sha256 (over the sorted JSON rows), tree_sha256 (over path, NUL, hash lines), from a narrow
    projection of paths, hashes, sizes and languages. One digest must pass over all of them in order, so one task sorts them (with
    spills) and streams them through both digests, holding a batch at a time."""
    import pyarrow as pa

    rows = files.select("rel_path", S.canonical(F.to_json(F.struct(F.col("language").alias("language_guess"), "rel_path", "sha256", "size"))).alias("j"), F.concat("rel_path", F.lit("\0"), "sha256", F.lit("\n")).alias("t"))

    def run(batches):
        n, manifest, tree = 0, hashlib.sha256(b"["), hashlib.sha256()
        for b in batches:
            for j, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                manifest.update((("," if n else "") + j).encode())
                tree.update((t or "").encode())
                n += 1
        manifest.update(b"]")
        yield pa.RecordBatch.from_pydict({"n": [n], "m": [manifest.hexdigest()], "t": [tree.hexdigest()]})

    # no files, perhaps no task: the digests of nothing
    found = rows.repartition(1).sortWithinPartitions("rel_path", "j", "t").mapInArrow(run, "n long, m string, t string")
    last = lambda c, none: F.coalesce(F.max_by(c, "n"), F.lit(none))
    return found.agg(last("n", 0).alias("n_files"), last("m", hashlib.sha256(b"[]").hexdigest()).alias("manifest_sha256"), last("t", hashlib.sha256().hexdigest()).alias("tree_sha256"))


def duplicates(files: DataFrame) -> DataFrame:
    """sha256, copies, first_path of contents that occur more than once: what a content-addressed cache reads once."""
    return files.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("rel_path").alias("first_path")).where("copies > 1")


def profile_signals(files: DataFrame, paths: list[str], markers: list[str], language: str = "php", sample: int = 3, head: int = 8192, least: int = 2) -> DataFrame:
    """signal, profile: special paths, and markers in the head of the first files of a language; `least` signals make it full."""
    by_path = files.where(F.col("rel_path").isin(paths)).select(F.concat(F.lit("path:"), "rel_path").alias("signal"))
    few = files.where(F.col("language") == language).orderBy("rel_path").limit(sample).select(F.substring("text", 1, head).alias("h"))
    by_text = few.select(F.explode(F.array(*map(F.lit, markers))).alias("m"), "h").where(F.contains("h", "m")).select(F.concat(F.lit("content:"), "m").alias("signal"))
    all_ = by_path.union(by_text)
    n = all_.agg(F.when(F.count("*") >= least, "full").otherwise("generic").alias("profile"))
    return all_.groupBy("signal").agg(F.count("*").alias("hits")).join(F.broadcast(n))


def manifest_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """rel_path, status: added, removed, changed or unchanged."""
    b, t = base.select("rel_path", F.col("sha256").alias("old")), target.select("rel_path", F.col("sha256").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return b.join(t, "rel_path", "full_outer").select("rel_path", status.alias("status"))


def wrapper_root(files: DataFrame, language: str = "php", most_levels: int = 3) -> DataFrame:
    """One row, root: the shallowest folder up to most_levels down with a file of the language directly in it, of several the one with most."""
    folder = F.regexp_replace("rel_path", "/?[^/]*$", "")
    depth = F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))
    rows = files.where(F.col("language") == language).select(folder.alias("root"), depth.alias("depth")).where(F.col("depth") <= most_levels)
    return rows.groupBy("root", "depth").count().orderBy("depth", F.desc("count"), "root").limit(1).select("root")


def with_cache(files: DataFrame, cache: DataFrame, lift_version: str) -> DataFrame:
    """files with the cached result (ir) of their content, null where it must still be lifted."""
    known = cache.where(F.col("lift_version") == lift_version).groupBy(F.col("sha256").alias("_sha")).agg(F.first("ir").alias("ir"))
    return files.join(known, F.col("sha256") == F.col("_sha"), "left").drop("_sha")


def write_snapshot(files: DataFrame, path: str) -> None:
    """files (rel_path, sha256, size, language) as JSON lines, and the hashes of the manifest beside them."""
    from .sinks import write_json_lines

    write_json_lines(files.select("rel_path", "sha256", "size", "language"), f"{path}/files", "rel_path")
    manifest_hashes(files).write.mode("overwrite").json(f"{path}/meta")
