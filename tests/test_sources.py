"""Readers, running totals over trees with one shared prefix, manifests of nothing, step traces and counters."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from factspark.functions import scalars as S
from factspark.operators import enrich, report
from factspark.sources import files, readers


def test_json_lines_and_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"rel_path":"a","size":1,"more":true}\n\n{"size":"x"}\nno json\n[1]\n{"rel_path":null}\n')
    rows, bad = readers.read_json_lines(spark, str(tmp_path / "a.jsonl"), "rel_path string, size long")
    assert sorted(map(tuple, rows.collect()), key=repr) == [("a", 1), (None, None)]
    assert sorted(r.line for r in bad.collect()) == ["[1]", "no json", '{"size":"x"}']
    (tmp_path / "m.json").write_text(json.dumps([{"rel_path": "a", "sha256": "00", "size": 3}, {"rel_path": "b"}], indent=1))
    assert [tuple(r) for r in readers.read_json_array(spark, str(tmp_path / "m.json"), readers.MANIFEST).orderBy("rel_path").collect()] == [("a", "00", 3, None), ("b", None, None, None)]


def test_tables(spark):
    spark.createDataFrame([(1, "x"), (2, None)], "id long, scan_id string").createOrReplaceTempView("some_findings")
    assert [r.id for r in readers.read_table(spark, "some_findings", scan_id="x").collect()] == [1]
    assert [r.id for r in readers.read_table(spark, "some_findings", scan_id=None).collect()] == [2]


def test_tables_of_a_database(spark):
    base = {"url": "jdbc:derby:memory:scans;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).select("id", (F.col("id") % 3).alias("kind")).write.format("jdbc").options(**base, dbtable="scans").save()
    rows = readers.read_table(spark, "scans", base, key="id", parts=4, kind=1)
    assert rows.rdd.getNumPartitions() == 4 and sorted(r.id for r in rows.collect()) == list(range(1, 100, 3))


def test_running_totals_where_all_paths_share_a_prefix(spark):
    draw = random.Random(3)
    rows = [(f"vendor/package/src/{draw.randrange(10**9):09d}.php", draw.randrange(1_000)) for _ in range(5_000)] + [(None, 7), ("é/ü.php", None)]
    d = spark.createDataFrame(rows, "rel_path string, size long").repartition(5)
    want, total = {}, 0
    for n, (p, size) in enumerate(sorted(rows, key=lambda r: (r[0] or "").encode()), 1):
        total += size or 0
        want[p] = (n, total)
    out = files.running_totals(d, "rel_path", {"n": F.lit(1).cast("long"), "total": F.col("size")}, ranges=32)
    assert out.columns == ["rel_path", "size", "n", "total"]
    assert {r.rel_path: (r.n, r.total) for r in out.collect()} == want
    assert files.running_totals(d.limit(0), "rel_path", {"n": F.lit(1)}).count() == 0


def test_manifest_of_nothing_and_of_unordered_files(spark):
    d = spark.createDataFrame([("b", "01", 2, "php"), ("a", "00", 1, "php")], "rel_path string, sha256 string, size long, language string")
    r = files.manifest_hashes(d).first()
    j = '[{"language_guess":"php","rel_path":"a","sha256":"00","size":1},{"language_guess":"php","rel_path":"b","sha256":"01","size":2}]'
    assert tuple(r) == (2, hashlib.sha256(j.encode()).hexdigest(), hashlib.sha256(b"a\x0000\nb\x0001\n").hexdigest())
    assert tuple(files.manifest_hashes(d.limit(0)).first()) == (0, hashlib.sha256(b"[]").hexdigest(), hashlib.sha256().hexdigest())


def test_missing_keys(spark):
    d = spark.createDataFrame([('{"a":1,"b":null}',), ("[1]",), ("{",), (None,), ("{}",)], "j string")
    assert [r[0] for r in d.select(S.missing_keys(F.col("j"), "a", "c")).collect()] == [["c"], None, None, None, ["a", "c"]]


def test_counters_and_step_trace(spark):
    d, seen = report.observed(spark.range(10), n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    assert d.count() == 10 and seen.get == {"n": 10, "even": 5}
    from test_scan import FILES, table
    from factspark.plans.scan import scan

    findings = scan(table(spark, FILES), "snap", "full").enriched
    raw = findings.drop("hypothesis", "skeptic", "blocked", "checks", "verification", "features", "score", "bucket")
    rows, steps = enrich.workflow(raw, "s1")
    n = raw.count()
    assert n and rows.count() == n
    assert [tuple(r) for r in steps.orderBy("nth").collect()] == [(0, "extract", "s1", None, n), (1, "analyst", "s1", "deterministic_template", None), (2, "skeptic", "s1", "deterministic_rules", None), (3, "finalize", "s1", None, n)]
