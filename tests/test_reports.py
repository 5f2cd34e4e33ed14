"""Pages with tallies, searches, and what a scan leaves on disk."""

import json

import pytest
from pyspark.sql import functions as F

from factspark.operators import report, rules
from factspark.plans.scan import scan
from factspark.sources import sinks
from test_scan import FILES, table

FOUND = "finding_id string, rule_id string, severity string"


def read(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_tallies_are_those_of_all_findings(spark):
    d = spark.createDataFrame([("a", "RULE-XSS-001", "LOW"), ("b", "RULE-XSS-001", "HIGH"), ("c", "RULE-SQLI-001", "HIGH")], FOUND)
    page, tallies = report.tallied_page(d, severity="high", kind="xss")
    assert [r.finding_id for r in page.collect()] == ["b"]
    assert {(r["of"], r["name"]): r.n for r in tallies.collect()} == {("total", ""): 1, ("severity", "LOW"): 1, ("severity", "HIGH"): 2, ("rule", "RULE-XSS-001"): 2, ("rule", "RULE-SQLI-001"): 1, ("type", "XSS"): 2, ("type", "SQLI"): 1}
    page, tallies = report.tallied_page(d.where("false"))
    assert page.count() == 0 and [tuple(r) for r in tallies.collect()] == [("total", "", 0)]


def test_search_and_order(spark):
    d = spark.createDataFrame([("Alpha", None), ("b", "has ALPHA"), ("c", "x"), (None, None)], "name string, description string")
    assert sorted(r.name for r in report.search(d, " alpha ", "name", "description").collect()) == ["Alpha", "b"]
    assert report.search(d, "", "name").count() == 4
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "name string, n int")
    assert [r.name for r in report.largest_first(counts).collect()] == ["c", "a", "b"]


def test_a_scan_is_written_and_read_back(spark, tmp_path):
    s = scan(table(spark, FILES[:3]), "snap", "full")
    meta = spark.createDataFrame([(r.id, r.owasp) for r in rules.PACKS["full"]], "rule_id string, owasp array<string>")
    sinks.write_report(s.enriched, s.groups, meta, str(tmp_path), "scan-1")
    full, plain, compact = (read(tmp_path / "findings" / x) for x in ("enriched", "candidates", "compact"))
    assert [r["finding_id"] for r in full] == sorted(r.finding_id for r in s.findings.select("finding_id").collect()) == [r["finding_id"] for r in plain]
    assert not {"score", "skeptic"} & set(plain[0]) and {"score", "bucket", "verdict"} <= set(compact[0]) and full[0]["scan_id"] == "scan-1"
    groups = read(tmp_path / "reports" / "groups")
    assert [g["max_conf"] for g in groups] == sorted((g["max_conf"] for g in groups), reverse=True) and sum(g["n"] for g in groups) == len(full)
    assert {r["owasp_id"]: r["n"] for r in read(tmp_path / "reports" / "owasp")} == {"A01:2021": 5, "A03:2021": 3, "A08:2021": 1}
    assert len(read(tmp_path / "trace")) == len(full)
    document = json.loads("".join(p.read_text() for p in sorted((tmp_path / "reports" / "findings").glob("part-*"))))
    assert document["scan_id"] == "scan-1" and [f["finding_id"] for f in document["findings"]] == [r["finding_id"] for r in full]
    assert {g["rule_id"] for g in read(tmp_path / "reports" / "shown")} == {r["rule_id"] for r in full}
    sinks.write_spans(s.spans, str(tmp_path / "spans"))
    assert spark.read.json(str(tmp_path / "spans")).count() == s.spans.count()
    s.release()


def test_status_log_and_lineage(spark, tmp_path):
    log = str(tmp_path / "log")
    for status, at in (("RUNNING", "2024-01-01 00:00:00"), ("COMPLETED", "2024-01-01 00:05:00")):
        sinks.append_status(spark, log, "s1", status, at=at)
    sinks.append_status(spark, log, "s2", "QUEUED")
    assert {r.scan_id: r.status for r in sinks.latest_status(spark, log).collect()} == {"s1": "COMPLETED", "s2": "QUEUED"}
    one = spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, sha256 string")
    two = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "rel_path string, sha256 string")
    assert {r.status for r in sinks.write_lineage(one, str(tmp_path / "l"), "v1").collect()} == {"added"}
    assert {r.rel_path: r.status for r in sinks.write_lineage(two, str(tmp_path / "l"), "v2", "v1").collect()} == {"a": "unchanged", "b": "changed", "c": "added"}
    rows = spark.createDataFrame([("s1", "x"), ("s2", "y"), (None, "z")], "scan_id string, v string")
    assert sorted(r.v for r in sinks.without_scan("s1", rows)[0].collect()) == ["y", "z"]


def test_documents_of_any_number_of_rows(spark, tmp_path):
    for n in (0, 1, 2, 500):
        rows = spark.range(n).select(F.concat(F.lit("é\""), "id").alias("k"), (F.col("id") % 3).alias("v")).repartition(5)
        sinks.write_document(rows, str(tmp_path / str(n)), {"a": "ü", "n": n} if n else {}, "rows", "v", "k")
        got = json.loads("".join(p.read_text() for p in sorted((tmp_path / str(n)).glob("part-*"))))
        assert got["rows"] == sorted(({"k": f'é"{i}', "v": i % 3} for i in range(n)), key=lambda r: (r["v"], r["k"])) and (not n or got["a"] == "ü")


def test_shown_groups_stats_and_tokens(spark):
    from factspark.functions import scalars as S
    from factspark.operators import structure

    g = spark.createDataFrame([("A", 0.9), ("B", 0.2), ("C", 0.5)], "rule_id string, max_conf double")
    assert [r.rule_id for r in report.shown(g, 0.4, ("C",)).collect()] == ["A"] and report.shown(g).count() == 3
    s = scan(table(spark, FILES[:3]), "snap", "full", keep=False)
    r = structure.stats(s.nodes, s.spans, s.facts).first()
    # a function's text counts on its first line too; there one text holds two sinks under one id
    assert (r.functions, r.methods, r.classes, r.callsites, r.truncated_files, r.sources, r.sinks, r.sanitizers) == (2, 0, 0, 7, 0, 4, 5, 0)
    tokens = ["ghp_" + "a" * 30, " ghp_" + "a" * 30 + " ", "", None, "https://x/y", "a b", "me@x", "short", "a" * 256, "é" * 30]
    t = spark.createDataFrame([(x,) for x in tokens], "t string").select(S.token_problem(F.col("t")).alias("p"))
    assert [r.p for r in t.collect()] == [None, None, None, None, "URL_OR_PATH", "URL_OR_PATH", "URL_OR_PATH", "FORMAT", "FORMAT", "FORMAT"]
    h = spark.createDataFrame([(200, None), (401, ""), (403, "API Rate Limit exceeded"), (403, "no"), (403, None), (404, ""), (500, "")], "s int, b string").select(S.http_problem(F.col("s")).alias("a"), S.http_problem(F.col("s"), F.col("b")).alias("b"))
    assert [tuple(r) for r in h.collect()] == [(None, None), ("AUTH", "AUTH"), ("HTTP", "RATE_LIMIT"), ("HTTP", "HTTP"), ("HTTP", "HTTP"), ("HTTP", "NOT_FOUND"), ("HTTP", "HTTP")]
