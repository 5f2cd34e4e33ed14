"""Scans of small programs from files to groups, and the graph they leave."""

import pytest
from pyspark.sql import functions as F

from factspark.operators import enrich, graph, platform, structure
from factspark.operators.lift import lift, spans_of
from factspark.plans.scan import parseable, scan
from factspark.sources.files import Quotas, classified

PLUGIN = """<?php
add_action('init', 'boot');
add_action('wp_ajax_nopriv_save', 'save');
function boot() { return 1; }
function save() {
  global $wpdb;
  $v = $_GET['v'];
  $wpdb->query("UPDATE t SET v = $v");
  echo "saved $v";
}
"""
FILES = [
    ("a/pdo.php", "<?php\n$db = new PDO($dsn);\n$id = $_GET['id'];\n$rows = $db->query(\"SELECT 1 WHERE id = $id\");\n"),
    ("b/plugin.php", PLUGIN),
    ("c/rest.php", "<?php\nregister_rest_route('a/v1', '/b', array('permission_callback' => '__return_true'));\n$x = unserialize($_POST['o']);\n"),
    ("d/inc.php", "<?php\n$p = $_GET['p'];\ninclude $p;\nrequire_once __DIR__ . '/x.php';\nsystem($p);\n"),
    ("e/note.txt", "eval($_GET['x']);"),
    ("f/xmlrpc.php", "<?php $o = $_REQUEST['option']; $m = 'GET' === $_SERVER['REQUEST_METHOD']; wp_verify_nonce($n);"),
    ("g/null.php", None),
    ("h/empty.php", ""),
]


def table(spark, rows=FILES):
    return spark.createDataFrame(rows, "rel_path string, text string").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))


@pytest.fixture(scope="module")
def full(spark):
    s = scan(table(spark), "snap", "full")
    yield s
    s.release()


def rows_of(s):
    return {(r.file, r.rule_id, r.source_line, r.sink_line): r for r in s.enriched.collect()}


def test_the_generic_profile_gives_the_known_score(spark):
    s = scan(table(spark, FILES[:1]), "snap", "generic-php")
    (r,) = s.enriched.collect()
    assert (r.rule_id, r.severity, r.source_line, r.sink_line, r.skeptic.verdict, r.verification, r.bucket) == ("RULE-SQLI-001", "MEDIUM", 3, 4, "DOWNGRADE", "INCONCLUSIVE", "VERY_LOW")
    assert r.score == pytest.approx(0.058)
    parts = enrich.explained(s.enriched, "generic-php").collect()
    assert 0.45 + sum(p.contribution for p in parts) == pytest.approx(0.058) and len(parts) == len(enrich.WEIGHTS)
    s.release()


def test_all_rules_of_the_full_profile(full):
    got = rows_of(full)
    assert set(got) == {
        ("a/pdo.php", "RULE-SQLI-001", 3, 4), ("a/pdo.php", "RULE-WP-IDOR-001", 3, 4),
        ("b/plugin.php", "RULE-SQLI-001", 7, 8), ("b/plugin.php", "RULE-XSS-001", 7, 9), ("b/plugin.php", "RULE-WP-IDOR-001", 7, 8), ("b/plugin.php", "RULE-WP-IDOR-001", 7, 9), ("b/plugin.php", "RULE-WP-AJAX-001", None, 2),
        ("c/rest.php", "RULE-WP-REST-001", None, 1), ("c/rest.php", "RULE-OBJINJ-001", None, 3),
        ("d/inc.php", "RULE-LFI-001", 2, 3), ("d/inc.php", "RULE-RCE-001", 2, 5),
        ("f/xmlrpc.php", "RULE-WP-NONCE-001", None, 1),
    }
    ajax = got["b/plugin.php", "RULE-WP-AJAX-001", None, 2]
    assert (ajax.score, ajax.bucket, ajax.verification) == (pytest.approx(0.47), "MEDIUM", "CONFIRMED")
    assert got["a/pdo.php", "RULE-SQLI-001", 3, 4].score == pytest.approx(0.008)
    assert len({r.finding_id for r in got.values()}) == len(got)
    assert full.groups.agg(F.sum("n")).first()[0] == len(got)
    assert enrich.trace(full.enriched).count() == len(got)
    assert all(status == "OK" for _, status in full.telemetry) and len(full.telemetry) == 14


def test_findings_do_not_depend_on_partitioning(spark, full):
    other = scan(table(spark).repartition(5), "snap", "full")
    assert {r.finding_id for r in other.findings.collect()} == {r.finding_id for r in full.findings.collect()}
    other.release()


def test_the_graph_is_whole(full):
    assert graph.dangling(full.nodes, full.edges).count() == 0
    labels = {r.label: r.n for r in full.nodes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert (labels["File"], labels["Function"], labels["HookRegistration"], labels["AjaxAction"], labels["Route"], labels["Entrypoint"], labels["HeuristicPattern"]) == (8, 2, 2, 1, 1, 1, 1)
    assert full.nodes.count() == full.nodes.select("id").distinct().count()
    rels = {r.rel for r in full.edges.select("rel").distinct().collect()}
    assert {"CONTAINS_IR", "DEFINED_IN", "HAS_CALLSITE", "CALLS", "CALLS_TARGET", "MISSING_GUARD", "HAS_ENTRYPOINT", "FLOWS_TO", "HAS_SINK"} <= rels
    assert parseable(full.files).first().n == 7


def test_nothing_is_found_in_nothing(spark):
    s = scan(table(spark, FILES[6:]), "snap", "full")
    assert s.enriched.count() == 0 and s.groups.count() == 0
    s.release()
    empty = scan(table(spark, []), "snap", "full")
    assert empty.findings.count() == 0
    empty.release()


def test_spans_and_facts_can_be_written(spark, tmp_path):
    s = scan(table(spark, FILES[:2]), "snap", "generic-php", work=str(tmp_path))
    assert s.findings.count() == 3 and not s.kept and (tmp_path / "facts").exists()


def test_vendored_callsites_are_left_out_and_calls_resolve_by_name(spark):
    text = "function helper(a) { return a; }\nfunction go(a) { return helper(a); }\nclass B { }\n"
    spans = lift(spark.createDataFrame([("x/app.js", "javascript", text), ("x/vendor/lib.js", "javascript", text)], "file string, language string, text string"))
    nodes, edges = structure.structure(spans, "s")
    assert {(r.file, r.label): r.n for r in structure.counts(nodes).collect()} == {("x/app.js", "Function"): 2, ("x/app.js", "Class"): 1, ("x/app.js", "Callsite"): 1, ("x/vendor/lib.js", "Function"): 2, ("x/vendor/lib.js", "Class"): 1}
    assert [(r.callee, r.resolution, r.line) for r in structure.resolution(nodes, edges).collect()] == [("helper", "UNKNOWN", 2)]
    named = nodes.withColumn("name", F.when(F.col("label") == "Function", F.regexp_extract("name", r"function (\w+)", 1)).otherwise(F.col("name")))
    assert [(r.caller, r.callee, r.resolution) for r in structure.resolution(named, edges).collect()] == [("go", "helper", "STATIC")]
    assert structure.exported(edges, nodes.where("label <> 'Symbol'")).where("rel = 'CALLS_TARGET'").count() == 0


def test_matches_count_lines_across_breaks_within_matches(spark):
    blob = "x\nadd_action(\n 'a', f); add_filter('b', g);\n\nadd_action('c', h);"
    b = spark.createDataFrame([("f", blob), ("g", "nothing"), ("h", None)], "file string, blob string")
    assert [(r.nth, r.line) for r in platform.matches(b, platform.HOOK).orderBy("nth").collect()] == [(0, 2), (1, 3), (2, 5)]


def test_a_capability_check_silences_open_actions(spark):
    guarded = PLUGIN + "current_user_can('edit');\n"
    s = scan(table(spark, [("p.php", guarded)]), "snap", "full")
    assert {r.rule_id for r in s.findings.collect()} == {"RULE-SQLI-001", "RULE-XSS-001"}
    s.release()


def test_statements_are_spans():
    text = "<?php\n$a = 1;\nif ($b) { f(); } else { $c = 2; }\nfor ($i = 0; $i < 3; $i++) g();\n$h = function($x) { return k($x); };\nreturn $_POST['x'];\n"
    got = [r[2] for r in spans_of(text, "php", "f")[0] if r[1] == "expression_statement"]
    assert got == ["$a = 1;", "f();", "$c = 2;", "g();", "$h = function($x) { return k($x); };"]
    assert [r[2] for r in spans_of(text, "php", "f")[0] if r[1] == "subscript_expression"] == ["$_POST['x']"]


@pytest.mark.parametrize("name", ["q76_scan", "q85_all_rules"])
def test_queries_scan_the_whole_table(spark, monkeypatch, name):
    """More files than a folder's scan takes by default: the query leaves none out."""
    import sys

    from factspark.plans.queries import QUERIES

    class Given(Exception):
        pass

    def given(files, snapshot, profile="full", quotas=Quotas(), **rest):
        raise Given(quotas)

    scans = sys.modules["factspark.plans.scan"]
    monkeypatch.setattr(scans, "scan", given)
    with pytest.raises(Given) as got:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    (quotas,) = got.value.args
    n = Quotas().max_files + 1
    many = spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".php")).alias("rel_path"), F.lit(2**40).alias("size"))
    kept = classified(scans.quota_kept(many, quotas), quotas)
    assert kept.where("parse_policy = 'parse' and language = 'php'").count() == n
