"""The walk of a tree against a plain recursive one, and from a folder to findings."""

import hashlib
import os
from pathlib import Path

import pytest

from factspark.plans.scan import NothingToScan, scan_tree
from factspark.sources import files as sources
from factspark.sources import walk


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    root, outside = top / "root", top / "outside"
    put = lambda p, data: (p.parent.mkdir(parents=True, exist_ok=True), p.write_bytes(data))
    put(root / "B.php", b"<?php echo $_GET['b'];\n")
    put(root / "a.php", b"<?php\n$x = $_GET['x'];\nmysqli_query($c, $x);\n")
    put(root / "a" / "Z.txt", b"plain")
    put(root / "a" / "b.html", b"<p>x</p>")
    put(root / "a.d" / "deep" / "er" / "k.php", b"<?php f();")
    put(root / "C" / "logo.png", b"\x89PNG\x00\x01" + b"x" * 5000)
    put(root / "C" / "latin.txt", "Größe".encode("latin-1"))
    put(root / "C" / "latin.php", "<?php // Größe\n".encode("latin-1"))
    put(root / "C" / "app.min.js", b"f()")
    put(root / "C" / "big.php", b"<?php " + b"x" * 6000)
    put(root / "C" / "empty.inc", b"")
    put(outside / "secret.php", b"<?php secret();")
    os.symlink(outside / "secret.php", root / "link_out.php")
    os.symlink(outside, root / "dir_out")
    os.symlink(root / "a", root / "Link_in")
    os.symlink(root / "a.php", root / "C" / "again.php")
    os.symlink(root / "nowhere", root / "broken.php")
    for i in range(30):
        put(root / "many" / f"d{i % 7}" / f"{'F' if i % 2 else 'f'}{i}.js", f"g({i});".encode())
    return root


def plain(root: Path, q: sources.Quotas, follow: bool = False):
    """(files, diagnostics, stopped) by recursion. A file: path, size, language, encoding, policy, hash."""
    files, told, total = [], [], 0

    class Stop(Exception):
        pass

    def down(cur, rel, depth):
        nonlocal total
        if depth > q.max_depth:
            return told.append((rel or ".", "MAX_DEPTH"))
        for entry in sorted(cur.iterdir(), key=lambda p: (p.name.lower(), p.name)):
            at = f"{rel}/{entry.name}" if rel else entry.name
            if entry.is_symlink() and not follow and root not in (target := entry.resolve()).parents and target != root:
                told.append((at, "SYMLINK_SKIPPED"))
                continue
            if entry.is_dir():
                down(entry.resolve(), at, depth + 1)
                continue
            if not entry.is_file():
                continue
            data, name = entry.read_bytes(), entry.name.lower()
            language = next((k for k, v in {"php": (".php", ".inc"), "javascript": (".js",), "html": (".html",)}.items() if name.endswith(v)), "other")
            big, bundle = len(data) > q.max_file_bytes, language == "javascript" and ".min." in name
            if len(files) >= q.max_files or not (big or bundle) and total + len(data) > q.max_total_bytes:
                told.append((at, "MAX_FILES" if len(files) >= q.max_files else "MAX_TOTAL_BYTES"))
                raise Stop
            total += 0 if big or bundle else len(data)
            digest = hashlib.sha256(data).hexdigest()
            if big or bundle:
                told.append((at, "FILE_TOO_LARGE" if big else "JS_BUNDLE_SKIPPED"))
                files.append((at, len(data), "other" if big else language, "utf-8", "skip_size", ""))
            elif language == "other" and b"\0" in data[:4096]:
                files.append((at, len(data), "binary", "utf-8", "skip_binary", hashlib.sha256(data[:4096]).hexdigest()))
            elif language == "other" and not _utf8(data):
                files.append((at, len(data), "other", "binary-ambiguous", "skip_encoding", ""))
            else:
                files.append((at, len(data), language, "utf-8", "parse", digest))

    try:
        down(root, "", 0)
    except Stop:
        return files, told, told[-1][0]
    return files, told, None


def _utf8(data: bytes) -> bool:
    try:
        return data.decode() is not None
    except UnicodeDecodeError:
        return False


QUOTAS = {"plain": {}, "files": {"max_files": 9}, "bytes": {"max_total_bytes": 120}, "depth": {"max_depth": 1}, "none": {"max_files": 0}}


@pytest.mark.parametrize("name", QUOTAS)
@pytest.mark.parametrize("partitions", [1, 4, 256])
def test_a_walk_is_the_recursive_one(spark, tree, name, partitions):
    q = sources.Quotas(**({"max_file_bytes": 5_500} | QUOTAS[name]))
    got = walk.ingest(spark, str(tree), q, partitions=partitions)
    files, told, stop = plain(tree, q)
    rows = got.files.orderBy("walk_key").collect()
    assert [(r.rel_path, r.size, r.language, r.encoding, r.parse_policy, r.sha256) for r in rows] == files
    assert [(r.path, r.code) for r in got.diagnostics.orderBy("walk_key").collect()] == told
    assert tuple(got.outcome.first()) == ("PARTIAL" if stop else "SUCCESS", stop)
    assert all((r.text is None) == (r.parse_policy != "parse" or r.language == "other") for r in rows)


def test_followed_links_and_what_is_no_folder(spark, tree):
    q = sources.Quotas(max_depth=5)
    got = walk.ingest(spark, str(tree), q, follow=True)
    files, told, _ = plain(tree, q, follow=True)
    assert [r.rel_path for r in got.files.orderBy("walk_key").collect()] == [f[0] for f in files] and "link_out.php" in {f[0] for f in files}
    none = walk.ingest(spark, str(tree / "nowhere"))
    assert none.outcome.first().status == "FAILED" and none.files.count() == 0
    assert [r.code for r in none.diagnostics.collect()] == ["NOT_A_DIRECTORY"]


def test_a_loop_of_links_ends_at_the_depth(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.php").write_text("<?php f();")
    os.symlink(tmp_path, tmp_path / "x" / "up")
    got = walk.ingest(spark, str(tmp_path), sources.Quotas(max_depth=6))
    assert [r.rel_path for r in got.files.orderBy("walk_key").collect()] == [f[0] for f in plain(tmp_path, sources.Quotas(max_depth=6))[0]]
    assert got.diagnostics.where("code = 'MAX_DEPTH'").count() == 1


def test_from_a_folder_to_findings(spark, tree, tmp_path):
    got, s = scan_tree(spark, str(tree), "snap", work=f"file://{tmp_path}/work")
    assert s.profile.id == "generic-php" and got.outcome.first().status == "SUCCESS"
    assert {(r.file, r.rule_id) for r in s.enriched.collect()} == {("a.php", "RULE-SQLI-001"), ("C/again.php", "RULE-SQLI-001")}
    m = sources.manifest_hashes(got.files).first()
    order = sorted(plain(tree, sources.Quotas())[0])
    assert m.n_files == len(order)
    assert m.tree_sha256 == hashlib.sha256("".join(f"{f[0]}\0{f[5]}\n" for f in order).encode()).hexdigest()
    wp = tmp_path / "wp"
    wp.mkdir()
    (wp / "p.php").write_text("<?php\nadd_action('init', 'f');\n$wpdb->query(\"x\");\n")
    assert scan_tree(spark, str(wp), "snap")[1].profile.id == "full"
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.txt").write_text("x")
    with pytest.raises(NothingToScan):
        scan_tree(spark, str(tmp_path / "text"), "snap")
