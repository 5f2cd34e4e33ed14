"""Packs, catalogs and settings from YAML, and scans that run by them."""

import pytest
from pyspark.sql import functions as F

from factspark.operators import facts, rules
from factspark.plans.scan import Options, scan
from factspark.sources import packs
from factspark.sources.files import Quotas

yaml = pytest.importorskip("yaml")

RULE = "- {{id: {}, severity_band: {}, python_evaluator_id: {}, min_graph_schema_version: '3.1', evaluator_params: {}}}\n"


def test_included_rules_come_first_and_cycles_fail(tmp_path):
    (tmp_path / "a.yaml").write_text("includes: [b.yaml]\nrules:\n- {id: R1, severity: HIGH, evaluator: x}\n- {id: R2, severity: HIGH, evaluator: x}\n")
    (tmp_path / "b.yaml").write_text("rules:\n- {id: R1, severity: LOW, evaluator: y}\n- {id: R0, severity: LOW, evaluator: y, owasp: [A01]}\n")
    (tmp_path / "c.yaml").write_text("includes: [c.yaml]\n")
    (tmp_path / "d.yaml").write_text("includes: [b.yaml, b.yaml]\n")
    assert [(r.id, r.severity) for r in packs.load_pack(tmp_path / "a.yaml")] == [("R0", "LOW"), ("R1", "LOW"), ("R2", "HIGH")]
    for bad in ("c.yaml", "d.yaml"):
        with pytest.raises(ValueError):
            packs.load_pack(tmp_path / bad)
    for i in range(7):
        (tmp_path / f"n{i}.yaml").write_text(f"includes: [n{i + 1}.yaml]\n")
    with pytest.raises(ValueError):
        packs.load_pack(tmp_path / "n0.yaml")
    for text in ("rules:\n- {id: R, evaluator: x}\n", "rules:\n- {id: R, severity: BAD, evaluator: x}\n"):
        (tmp_path / "e.yaml").write_text(text)
        with pytest.raises(ValueError):
            packs.load_pack(tmp_path / "e.yaml")


def test_settings(tmp_path):
    assert packs.settings({"a": {"x": 1, "y": 2}}, {"a": {"x": 3}}, {"b": 1}) == {"a": {"x": 3, "y": 2}, "b": 1}
    (tmp_path / "s.yaml").write_text("ingest: {max_files: 7, max_depth: 3}\nsemantic: {taint_path_sensitive_enabled: true}\n")
    got = packs.load_settings(tmp_path / "s.yaml", tmp_path / "none.yaml", environment={"FACTSPARK_INGEST__MAX_FILES": "9", "HOME": "x"}, graph={"schema_version": "3.2"}, parse=None)
    assert got == {"ingest": {"max_files": 9, "max_depth": 3}, "semantic": {"taint_path_sensitive_enabled": True}, "graph": {"schema_version": "3.2"}}
    quotas, options = packs.scan_options(got)
    assert Quotas(**quotas) == Quotas(max_files=9, max_depth=3) and Options(**options) == Options(schema="3.2", interprocedural=True)


CATALOG = r"""
catalog_id: mine
version: "2"
patterns:
  - {label: Source, pattern: "\\bgiven\\(", props: {kind: HTTP_SUPERGLOBAL, context: HTTP_INPUT, name: given}}
  - {label: Sink, pattern: "\\bruns\\(", props: {kind: CODE_EXEC, context: CODE, api: runs}}
  - {label: Sink, pattern: "\\bruns\\(", props: {kind: CODE_EXEC, api: runs}}
  - {label: Sanitizer, pattern: "\\bclean\\("}
heuristic_patterns:
  - {name: NONCE_GET_ONLY, requirements: ["given", "runs"]}
"""
FILES = [("p.php", "<?php\n$x = given();\nruns($x);\n"), ("q.php", "<?php\n$x = $_SERVER['x'];\nreadfile($x);\nsystem($x);\n$y = $_GET['y'];\nreadfile(ABSPATH . $y);\nsystem($y);\n")]


def table(spark):
    return spark.createDataFrame(FILES, "rel_path string, text string").withColumn("size", F.octet_length("text").cast("long"))


def test_a_catalog_of_ones_own(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(CATALOG)
    c = packs.merged_catalog(packs.load_catalog(tmp_path / "c.yaml"), packs.load_catalog(tmp_path / "c.yaml"))
    assert (c.id, c.version, c.languages, len(c.patterns)) == ("mine|mine", "2.2", ("php",), 3)
    assert c.patterns[0] == facts.Pattern("Source", r"\bgiven\(", "HTTP_SUPERGLOBAL", "HTTP_INPUT", name="given") and c.patterns[2].kind == "Sanitizer"
    options = Options(patterns=c.patterns, heuristics=c.heuristics, pack=[rules.Rule("RULE-RCE-001", "LOW", "rce_graph", params={"require_primary_sources": False}), rules.Rule("RULE-WP-NONCE-001", "INFO", "wp_nonce_get_only")])
    got = {(r.rule_id, r.severity, r.file, r.sink_line) for r in scan(table(spark), "s", "generic-php", options=options, keep=False).findings.collect()}
    assert got == {("RULE-RCE-001", "LOW", "p.php", 3), ("RULE-WP-NONCE-001", "INFO", "p.php", 1)}


def findings(spark, tmp_path, text):
    (tmp_path / "p.yaml").write_text("rules:\n" + text)
    s = scan(table(spark), "s", "generic-php", options=Options(pack=packs.load_pack(tmp_path / "p.yaml")), keep=False)
    return {(r.rule_id, r.severity, r.sink_line) for r in s.findings.collect()}, dict(s.telemetry)


def test_params_of_a_pack_change_findings(spark, tmp_path):
    built_in = RULE.format("RULE-RFI-001", "HIGH", "rfi_graph", "{require_non_static_sink: true}") + RULE.format("RULE-RCE-001", "CRITICAL", "rce_graph", "{require_primary_sources: true}")
    got, told = findings(spark, tmp_path, built_in)
    # the second path is fixed in the code, the first source isn't a primary one
    assert got == {("RULE-RFI-001", "HIGH", 3), ("RULE-RCE-001", "CRITICAL", 7)} and set(told.values()) == {"OK"}
    other = RULE.format("RULE-RFI-001", "LOW", "rfi_graph", "{require_non_static_sink: false}") + RULE.format("RULE-RCE-001", "HIGH", "rce_graph", "{require_primary_sources: false}")
    got, _ = findings(spark, tmp_path, other)
    assert got == {("RULE-RFI-001", "LOW", 3), ("RULE-RFI-001", "LOW", 6), ("RULE-RCE-001", "HIGH", 4), ("RULE-RCE-001", "HIGH", 7)}


def test_a_rule_that_only_params_describe(spark, tmp_path):
    text = RULE.format("MY-1", "INFO", "flow", "{sink_kind: CODE_EXEC, labels: [A], title: mine, emit_one_per_sink: false}") + RULE.format("MY-2", "INFO", "rce_graph", "{}") + "- {id: MY-3, severity: LOW, evaluator: nothing}\n- {id: MY-4, severity: LOW, evaluator: flow, enabled: false}\n"
    got, told = findings(spark, tmp_path, text)
    # MY-2 names the evaluator of another rule, whose findings aren't its own
    assert got == {("MY-1", "INFO", 4), ("MY-1", "INFO", 7)}
    assert told == {"MY-1": "OK", "MY-2": "OK", "MY-3": "NO_EVALUATOR", "MY-4": "RULE_DISABLED"}


def test_quotas_hold_in_a_scan(spark):
    s = scan(table(spark), "s", "generic-php", Quotas(max_files=1), keep=False)
    assert [r.rel_path for r in s.files.collect()] == ["p.php"]
    assert [r.rel_path for r in scan(table(spark), "s", "generic-php", Quotas(max_total_bytes=40), keep=False).files.collect()] == ["p.php"]


@pytest.mark.parametrize(("asked", "signals", "got"), [("auto", 2, "full"), ("auto", 1, "generic-php"), (None, 9, "full"), ("wordpress", 0, "wordpress"), ("x", 0, "full"), (" Generic-PHP ", 5, "generic-php")])
def test_profiles(asked, signals, got):
    p = rules.resolve_profile(asked, signals)
    assert p.id == got and (p.pack, p.adapters) == (("generic-php", ()) if got == "generic-php" else ("full", ("wordpress",)))
