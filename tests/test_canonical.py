"""JSON and digests as writers that keep to ASCII make them."""

import hashlib
import json

from pyspark.sql import functions as F

from factspark.functions import scalars as S
from factspark.operators import enrich, flows, report, rules
from factspark.sources import files as sources

TEXTS = ["", "plain", 'a "b" \\ / c', "ü é ß", "日本", "😀 x 𝒳", "\x00\x01\x0a\x0b\x1a\x1f\x7f\t\r\b\f", "\\u001A \\\\u001F", "\x1a\\\x1b", "é\x1cé", "\\\x1d", " ﻿￿"]


def test_canonical_json_is_that_of_plain_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = rows.select("i", S.canonical(F.to_json(F.struct(F.col("i").alias("a"), F.col("t").alias("b")))).alias("j")).collect()
    for r in got:
        assert r.j == json.dumps({"a": r.i, "b": TEXTS[r.i]}, sort_keys=True, separators=(",", ":")), ascii(TEXTS[r.i])


def test_ids_of_paths_beyond_ascii(spark):
    facts = [("dir/ü😀.php", 1, 0, "source:s:dir/ü😀.php:1:0", "Source", "HTTP_SUPERGLOBAL", "HTTP_INPUT", "$_GET", False), ("dir/ü😀.php", 2, 1, "sink:s:dir/ü😀.php:2:9", "Sink", "HTML", "HTML", "", False)]
    f = spark.createDataFrame(facts, "file string, line int, ord long, id string, label string, kind string, context string, name string, static boolean")
    (r,) = enrich.enriched(rules.flow_findings(flows.flows(f), rules.FLOW_RULES["RULE-XSS-001"])).collect()
    src, dst = facts[0][3], facts[1][3]
    witness = {
        "path_edges": [f"{src}|FLOWS_TO|{dst}"], "summary_hops": [{"from_id": src, "to_id": dst, "edge_kind": "FLOWS_TO"}], "taint_labels": ["HTTP_SUPERGLOBAL", "HTML"],
        "semantic_trace": [f"graph:source:{src}", f"graph:sink:{dst}", "lift_derived_flow"], "constraint_summary": {"approximate_flow": True}, "analysis_limits": ["exposure_not_gated"],
    }
    digest = hashlib.sha256(json.dumps(witness, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    assert r.finding_id == f"FINDING|RULE-XSS-001|{dst}|{dst}|{digest}"
    checks = [("HAS_WITNESS_PATH", {"edges": 1}, True), ("ANCHOR_LINE_POSITIVE", {"anchors": 2}, True), ("SEMANTIC_TRACE_PRESENT_OR_COARSE", {"semantic_trace_len": 3}, True), ("ANALYSIS_LIMITS_EXPLICIT_IF_PRESENT", {"analysis_limits": 1}, True), ("APPROX_FLOW_ACKNOWLEDGED", {"approximate": True}, None)]
    assert r.artifact_sha256 == hashlib.sha256(json.dumps([{"check_id": c, "passed": p, "details": d} for c, d, p in checks], sort_keys=True).encode()).hexdigest()


def test_the_manifests_hash(spark):
    rows = [("ü/b.php", "b" * 64, 3, "php"), ("a😀.js", "a" * 64, 2**40, "javascript"), ("Z", "", 0, "other")]
    got = sources.manifest_hashes(spark.createDataFrame(rows, "rel_path string, sha256 string, size long, language string")).first()
    want = [{"rel_path": p, "sha256": h, "size": s, "language_guess": g} for p, h, s, g in sorted(rows)]
    assert got.manifest_sha256 == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_states_of_jobs_without_any_input(spark):
    empty = {"recorded": "scan_id long, slug string, status string, started_at timestamp, findings long, error string, output_dir string", "memory": "scan_id long, slug string, status string, progress string, findings long, error string, output_dir string", "log": "scan_id long, at string, status string, stage string, detail string, progress_pct string, error string", "artifacts": "scan_id long, output_dir string, findings long", "queue": "scan_id long, position long"}
    tables = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    assert report.job_states(**tables, now=F.current_timestamp()).count() == 0
    tables["memory"] = spark.createDataFrame([(1, "s", None, None, None, None, None), (2, "s", "RUNNING", None, 4, "e", "d")], empty["memory"])
    tables["queue"] = spark.createDataFrame([(2, 0)], empty["queue"])
    got = {r.scan_id: tuple(r)[1:] for r in report.job_states(**tables, now=F.current_timestamp()).collect()}
    assert got == {1: ("s", "UNKNOWN", None, None, None, 0, None, None), 2: ("s", "RUNNING", "starting", "Starting scan worker…", 1.0, 4, "e", "d")}
