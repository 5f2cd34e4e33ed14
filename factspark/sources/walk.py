"""A source tree on a mounted file system as rows: a data source with a partition per subtree, then quotas, policies, hashes and
diagnostics as DataFrame steps. (`files.read_tree` reads trees in any store of Spark's, without links.)"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars as S
from . import files as sources
from .staging import shared_folder, written

SCHEMA = "walk_key string, rel_path string, size long, mtime_ns long, content binary, code string, message string"
_TYPES = {"walk_key": pa.string(), "rel_path": pa.string(), "size": pa.int64(), "mtime_ns": pa.int64(), "content": pa.binary(), "code": pa.string(), "message": pa.string()}
#: Bytes and rows of a batch; bytes that tell binary files; subtrees that the driver looks for, by listing the upper folders.
BATCH_BYTES, BATCH_ROWS, HEAD, PARTITIONS = 8 * 1024**2, 1_000, 4_096, 256
# Codes and their messages.
MESSAGES = {
    "NOT_A_DIRECTORY": "plugin root must be a directory",
    "MAX_DEPTH": "max_depth {} exceeded",
    "SYMLINK_SKIPPED": "external symlink skipped",
    "SYMLINK_ERROR": "could not resolve symlink",
    "FILE_TOO_LARGE": "skipped: exceeds max_single_file_bytes",
    "JS_BUNDLE_SKIPPED": "skipped: minified/webpack JS bundle (>200KB or vendor/bundle/min name)",
    "HASH_ABORT": "file grew beyond quota during hash",
    "MAX_FILES": "max_files {}",
    "MAX_TOTAL_BYTES": "quota exceeded",
}


def walk_key(rel: str) -> str:
    """Sorts like the walk: by lower-case names, level by level, a folder's content where its name stands."""
    return rel.lower().replace("/", "\0")


@dataclass
class Folder(InputPartition):
    """A folder (its real path, its path in the walk, its depth), with all below it or only what lies directly in it."""

    path: str
    rel: str
    depth: int
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.root = os.path.realpath(options["path"])
        self.most_bytes, self.most_depth = int(options["maxfilebytes"]), int(options["maxdepth"])
        self.follow = options.get("followsymlinks", "false").lower() == "true"
        self.parts = int(options.get("partitions", PARTITIONS))

    def partitions(self) -> list[Folder]:
        """Folders are listed level by level until there are enough subtrees; folders above these are partitions without what is below."""
        level, upper = [Folder(self.root, "", 0, True)], []
        while level and len(level) < self.parts:
            below = [Folder(p, rel, f.depth + 1, True) for f in level for kind, rel, p in self._entries(f) if kind == "dir"]
            upper += [Folder(f.path, f.rel, f.depth, False) for f in level]
            level = below
        return upper + level

    def _entries(self, f: Folder) -> Iterator[tuple[str, str, str]]:
        """("dir" or "file", path in the walk, real path) or (code, path in the walk, message) of what lies directly in a folder, in order."""
        if f.depth > self.most_depth:
            yield "MAX_DEPTH", f.rel or ".", MESSAGES["MAX_DEPTH"].format(self.most_depth)
            return
        if f.depth == 0 and not os.path.isdir(f.path):
            yield "NOT_A_DIRECTORY", f.path, MESSAGES["NOT_A_DIRECTORY"]
            return
        try:
            names = sorted(os.listdir(f.path), key=lambda n: (n.lower(), n))
        except OSError as e:
            yield "LISTDIR_ERROR", f.rel or ".", str(e)
            return
        for name in names:
            path, rel = os.path.join(f.path, name), f"{f.rel}/{name}" if f.rel else name
            if os.path.islink(path) and not self.follow:
                try:
                    target = Path(path).resolve()
                except (OSError, RuntimeError):
                    yield "SYMLINK_ERROR", rel, MESSAGES["SYMLINK_ERROR"]
                    continue
                if not target.is_relative_to(self.root):
                    yield "SYMLINK_SKIPPED", rel, MESSAGES["SYMLINK_SKIPPED"]
                    continue
            if os.path.isdir(path):
                yield "dir", rel, os.path.realpath(path)
            elif os.path.isfile(path):
                yield "file", rel, path

    def _file(self, rel: str, path: str) -> tuple:
        row = lambda size, mtime, content, code=None, message=None: (walk_key(rel), rel, size, mtime, content, code, message or MESSAGES.get(code))
        try:
            st = os.stat(path)
        except OSError as e:
            return row(None, None, None, "STAT_ERROR", str(e))
        name = os.path.basename(path).lower()
        if st.st_size > self.most_bytes:
            return row(st.st_size, st.st_mtime_ns, None, "FILE_TOO_LARGE")
        if os.path.splitext(name)[1] in S.LANGUAGES["javascript"] and (st.st_size > S.BUNDLE_BYTES or any(h in name for h in S.BUNDLE_HINTS)):
            return row(st.st_size, st.st_mtime_ns, None, "JS_BUNDLE_SKIPPED")
        try:
            with open(path, "rb") as f:
                content = f.read(self.most_bytes + 1)
        except OSError as e:
            return row(None, None, None, "READ_ERROR", str(e))
        if len(content) > self.most_bytes:
            return row(None, None, None, "HASH_ABORT")
        return row(st.st_size, st.st_mtime_ns, content)

    def _rows(self, top: Folder) -> Iterator[tuple]:
        todo = [top]
        while todo:
            f = todo.pop()
            for kind, rel, at in self._entries(f):
                if kind == "file":
                    yield self._file(rel, at)
                elif kind == "dir":
                    todo += [Folder(at, rel, f.depth + 1, True)] if f.deep else []
                else:
                    yield walk_key(rel), rel, None, None, None, kind, at

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.values(), strict=True)], list(_TYPES))
        for r in self._rows(partition):
            rows.append(r)
            size += len(r[4] or b"")
            if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class TreeSource(DataSource):
    """`spark.read.format("tree").load(root)`: a row per file (content null where a code says why) and per complaint (size null)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_walk(spark: SparkSession, root: str, q: sources.Quotas = sources.Quotas(), follow: bool = False, partitions: int = PARTITIONS) -> DataFrame:
    spark.dataSource.register(TreeSource)
    options = {"maxFileBytes": q.max_file_bytes, "maxDepth": q.max_depth, "followSymlinks": str(follow).lower(), "partitions": partitions}
    return spark.read.format("tree").options(**options).load(root)


@dataclass
class Ingest:
    """files (rel_path, size, mtime_ns, language, encoding, parse_policy, sha256, text: null but for files that are parsed, walk_key),
    diagnostics (path, code, message, walk_key) and outcome (one row: status, stopped_at)."""

    files: DataFrame
    diagnostics: DataFrame
    outcome: DataFrame


def ingest(spark: SparkSession, root: str, q: sources.Quotas = sources.Quotas(), follow: bool = False, work: str | None = None, partitions: int = PARTITIONS) -> Ingest:
    """A walk with its quotas: the walk ends before the first file, in its order, that is one too many or whose bytes are.

    The tree is read once, into a table below work (without it in the shared folder); all else works on that table."""
    rows = written(read_walk(spark, root, q, follow, partitions), f"{work or shared_folder(spark, 'ingest')}/walk")
    counted = rows.where("size is not null").select("walk_key", "rel_path", F.when(F.col("content").isNotNull(), F.col("size")).otherwise(F.lit(0)).alias("bytes"))
    n, size = counted.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    stop = None
    if n > q.max_files or size > q.max_total_bytes:
        totals = sources.running_totals(counted, "walk_key", {"n": F.lit(1).cast("long"), "total": F.col("bytes")})
        stop = totals.where((F.col("n") > q.max_files) | (F.col("total") > q.max_total_bytes)).agg(F.min(F.struct("walk_key", "rel_path", "n")).alias("s")).first()["s"]
        rows = rows.where(F.col("walk_key") < stop["walk_key"])
    told = rows.where("code is not null").select(F.col("rel_path").alias("path"), "code", "message", "walk_key")
    if stop:
        code = "MAX_FILES" if stop["n"] > q.max_files else "MAX_TOTAL_BYTES"
        told = told.union(spark.createDataFrame([(stop["rel_path"], code, MESSAGES[code].format(q.max_files), stop["walk_key"])], told.schema))

    content = F.col("content")
    by_name = F.when(F.col("code") == "FILE_TOO_LARGE", "other").when(F.col("code") == "JS_BUNDLE_SKIPPED", "javascript").otherwise(S.language(F.col("rel_path")))
    other = (by_name == "other") & content.isNotNull()
    binary, ambiguous = other & sources.is_binary(content, HEAD), other & F.try_validate_utf8(content.cast("string")).isNull()
    policy = F.when(content.isNull(), "skip_size").when(binary, "skip_binary").when(ambiguous, "skip_encoding").otherwise("parse")
    found = rows.where("size is not null").select(
        "rel_path", "size", "mtime_ns", F.when(binary, "binary").otherwise(by_name).alias("language"),
        F.when(~binary & ambiguous, "binary-ambiguous").otherwise("utf-8").alias("encoding"), policy.alias("parse_policy"),
        F.when(policy == "parse", F.sha2(content, 256)).when(policy == "skip_binary", F.sha2(F.substring(content, 1, HEAD), 256)).otherwise("").alias("sha256"),
        F.when((policy == "parse") & (by_name != "other"), sources.decoded(content, q.max_file_bytes)[0]).alias("text"), "walk_key",
    )
    ends = told.agg(F.count_if(F.col("code") == "NOT_A_DIRECTORY").alias("none"), F.min(F.when(F.col("code").isin("HASH_ABORT", "MAX_FILES", "MAX_TOTAL_BYTES"), F.struct("walk_key", "path"))).alias("stop"))
    outcome = ends.select(F.when(F.col("none") > 0, "FAILED").when(F.col("stop").isNotNull(), "PARTIAL").otherwise("SUCCESS").alias("status"), F.col("stop.path").alias("stopped_at"))
    return Ingest(found, told, outcome)
