"""Archives of source files as rows: zip and tar members, by a data source over archives on a mounted file system, where a large zip
is read by several tasks, or from the rows that binaryFile reads from any store."""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, rel_path string, size long, content binary, error string"
_TYPES = {"archive": pa.string(), "rel_path": pa.string(), "size": pa.int64(), "content": pa.binary(), "error": pa.string()}
#: Fixed value: bytes of an archive that is taken. Bytes of a zip's members that one task reads, and of a batch of rows.
MOST_ARCHIVE, PART_BYTES, BATCH_BYTES = 512 * 1024**2, 64 * 1024**2, 8 * 1024**2


def members(name: str, content: bytes, most: int) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the regular files of an archive up to `most` bytes each; paths that leave the archive lose those steps."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if not m.is_dir() and m.file_size <= most:
                    yield _inside(m.filename), z.read(m)
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.isfile() and m.size <= most:
                    yield _inside(m.name), t.extractfile(m).read()


def _inside(path: str) -> str:
    return "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", ".", ".."))


def read_archives(archives: DataFrame, most: int = 50 * 1024**2) -> DataFrame:
    """archives (path, content, as binaryFile reads them) to archive, rel_path, size, content; a broken archive is one row with
    error. An archive is a value of binaryFile, so it is in memory as a whole (2 GB at most); its members go on one by one."""
    names, types = list(_TYPES), list(_TYPES.values())

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for name, data in members(path, content, most):
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, name, len(data), data, None), types, strict=True)], names)
                except (zipfile.BadZipFile, tarfile.TarError, OSError) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, None, None, None, str(e)), types, strict=True)], names)

    return archives.select(F.col("path"), F.col("content")).mapInArrow(run, SCHEMA)


@dataclass
class Part(InputPartition):
    """An archive, or the members of a zip from one place in its directory to another."""

    path: str
    first: int = 0
    last: int | None = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.most, self.most_archive, self.part = (int(options[k]) for k in ("maxmemberbytes", "maxarchivebytes", "partbytes"))

    def partitions(self) -> list[Part]:
        """A part per archive; of a zip beyond PART_BYTES the directory, which stands at its end, tells where to cut."""
        names = sorted(os.listdir(self.path)) if os.path.isdir(self.path) else [""]
        paths = [os.path.join(self.path, n) if n else self.path for n in names if not n or n.lower().endswith((".zip", ".tar", ".tgz", ".tar.gz"))]
        return [part for p in paths for part in self._cut(p)]

    def _cut(self, path: str) -> Iterator[Part]:
        if not path.lower().endswith(".zip") or os.path.getsize(path) <= self.part or os.path.getsize(path) > self.most_archive:
            yield Part(path)
            return
        try:
            sizes = [m.compress_size for m in zipfile.ZipFile(path).infolist()]
        except (zipfile.BadZipFile, OSError):
            yield Part(path)
            return
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > self.part:
                yield Part(path, first, i)
                first, held = i, 0
            held += n
        yield Part(path, first, len(sizes))

    def _members(self, part: Part) -> Iterator[tuple]:
        broken = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, NotImplementedError, RuntimeError)
        row = lambda name, data, error=None: (part.path, name, None if data is None else len(data), data, error)
        if os.path.getsize(part.path) > self.most_archive:
            yield row(None, None, f"larger than {self.most_archive} bytes")
            return
        try:
            if not part.path.lower().endswith(".zip"):
                with tarfile.open(part.path, "r|*") as t:
                    for m in t:
                        if m.isfile() and m.size <= self.most:
                            data = t.extractfile(m).read()
                            yield row(_inside(m.name), data) if len(data) == m.size else row(_inside(m.name), None, "ends before its size")
                return
            with zipfile.ZipFile(part.path) as z:
                for m in z.infolist()[part.first : part.last]:
                    if m.is_dir() or m.file_size > self.most:
                        continue
                    try:  # a damaged member leaves the others readable
                        with z.open(m) as f:
                            data = f.read(self.most + 1)
                    except broken as e:
                        yield row(_inside(m.filename), None, str(e))
                        continue
                    yield row(_inside(m.filename), data) if len(data) <= self.most else row(_inside(m.filename), None, "larger than its directory says")
        except broken as e:
            yield row(None, None, str(e))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.values(), strict=True)], list(_TYPES))
        for r in self._members(partition):
            rows.append(r)
            size += len(r[3] or b"")
            if size > BATCH_BYTES or len(rows) >= 1_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    """`spark.read.format("archive").load(path)`: the members of an archive, or of the archives of a folder."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def scan_archives(spark: SparkSession, path: str, most: int = 50 * 1024**2, most_archive: int = MOST_ARCHIVE, part: int = PART_BYTES) -> DataFrame:
    """archive, rel_path, size, content, error of the regular members, up to `most` bytes each, of an archive or of a folder's archives.
    Paths that leave the archive lose those steps. A broken archive or member, and an archive of more than most_archive bytes, is
    a row with error. A task holds a batch of members, not an archive; a zip of more than `part` bytes is read by several."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(maxMemberBytes=most, maxArchiveBytes=most_archive, partBytes=part).load(path)
