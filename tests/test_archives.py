"""Archives as a data source."""

import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from factspark.sources import archives


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top, rng = tmp_path_factory.mktemp("archives"), random.Random(1)
    files = {f"d{i % 3}/f{i}.php": rng.randbytes(rng.randrange(3_000)) for i in range(80)} | {"../../up.php": b"<?php", "/abs/x.js": b"x", "e.txt": b""}
    with zipfile.ZipFile(top / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("dir")
        for name, data in files.items():
            z.writestr(name, data)
    for name in ("b.tar", "c.tgz"):
        with tarfile.open(top / name, "w:gz" if name == "c.tgz" else "w") as t:
            for member, data in files.items():
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            t.addfile(link)
    (top / "broken.zip").write_bytes(b"no zip")
    (top / "cut.tar").write_bytes((top / "b.tar").read_bytes()[:1_000])
    (top / "other.txt").write_text("x")
    return top, {n.replace("../", "").lstrip("/"): d for n, d in files.items()}


@pytest.mark.parametrize("part", [1, 20_000, archives.PART_BYTES])
def test_members_of_zips_and_tars(spark, folder, part):
    top, files = folder
    rows = archives.scan_archives(spark, str(top), part=part)
    if part == 20_000:
        assert rows.where("archive like '%a.zip'").select(F.spark_partition_id()).distinct().count() > 2
    got = rows.collect()
    for name in ("a.zip", "b.tar", "c.tgz"):
        assert {r.rel_path: bytes(r.content) for r in got if r.archive.endswith(f"/{name}")} == files
    assert all(r.size == len(r.content) for r in got if not r.error)
    assert {r.archive.rsplit("/", 1)[1] for r in got if r.error} == {"broken.zip", "cut.tar"} and not any(r.archive.endswith(".txt") for r in got)


def test_limits_and_damaged_members(spark, folder, tmp_path):
    top, files = folder
    few = archives.scan_archives(spark, str(top / "a.zip"), most=1_000).collect()
    assert {r.rel_path for r in few} == {n for n, d in files.items() if len(d) <= 1_000}
    (r,) = archives.scan_archives(spark, str(top / "a.zip"), most_archive=100).collect()
    assert r.rel_path is None and "larger" in r.error
    data = bytearray((top / "a.zip").read_bytes())
    at = data.index(b"d1/f1.php") + 200  # within the first members' bytes
    data[at : at + 20] = bytes(20)
    (tmp_path / "bad.zip").write_bytes(data)
    rows = archives.scan_archives(spark, str(tmp_path / "bad.zip")).collect()
    assert len(rows) == len(files) and 1 <= sum(r.error is not None for r in rows) < 5
    assert all(bytes(r.content) == files[r.rel_path] for r in rows if not r.error)
