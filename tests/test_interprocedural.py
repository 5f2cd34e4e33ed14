"""Flows between files: numbering without a product, the program's strength, and what a scan makes of them."""

import random

import pytest
from pyspark.sql import functions as F

from factspark.operators import flows, interprocedural, rules
from factspark.plans.scan import Options, scan

FACTS = "file string, line int, ord long, id string, label string, kind string, context string, name string, static boolean"


def facts_of(spark, seed, files=6, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice(["Source", "Sink", "Sink", "Sanitizer"])
        kind = {"Source": rng.choice(["HTTP_SUPERGLOBAL", None, "ENV"]), "Sink": rng.choice(["SQL", "HTML", "CSV_OUTPUT"]), "Sanitizer": rng.choice(["SQL_PREPARE", "SANITIZE"])}[label]
        rows.append((f"f{rng.randrange(files)}", rng.randrange(12), i, f"n{rng.randrange(10**6)}-{i}", label, kind, rng.choice(["SQL", "HTML"]), "$_GET", rng.random() < 0.2))
    return rows, spark.createDataFrame(rows, FACTS).repartition(3)


def pairs_of(rows):
    """Every pair, by two loops in order."""
    at = lambda r: (r[0], r[1], r[3])
    sources = sorted((r for r in rows if r[4] == "Source" and (r[5] or "HTTP_SUPERGLOBAL") == "HTTP_SUPERGLOBAL"), key=at)
    sinks = sorted((r for r in rows if r[4] == "Sink" and r[5] in ("SQL", "HTML") and not r[8]), key=at)
    return [(s, k) for s in sources for k in sinks if s[0] != k[0]]


@pytest.mark.parametrize("cap", [1, 9, 333, 100_000, 200_000])
def test_pairs_are_the_first_of_the_product(spark, cap):
    rows, df = facts_of(spark, cap)
    got = flows.cross_file_flows(df, cap, "id").collect()
    assert [(r.src, r.dst) for r in got] == [(s[3], k[3]) for s, k in pairs_of(rows)[:cap]]
    assert [r.pair for r in got] == list(range(len(got)))


def test_one_file_has_no_partners_and_a_hot_file_has_few(spark):
    rows, df = facts_of(spark, 3, files=1)
    assert flows.cross_file_flows(df).count() == 0
    hot = [("a", i, i, f"k{i}", "Sink", "SQL", "", "", False) for i in range(3_000)] + [("a", 0, 1, "s0", "Source", None, "", "$_GET", False), ("b", 0, 1, "s1", "Source", None, "", "$_GET", False), ("b", 4, 2, "k", "Sink", "HTML", "", "", False)]
    got = flows.cross_file_flows(spark.createDataFrame(hot, FACTS), 100, "id").collect()
    assert [(r.src, r.dst) for r in got] == [(s[3], k[3]) for s, k in pairs_of(hot)[:100]] and got[0].dst == "k"


NODES = "id string, label string, name string, kind string, file string, line int"


def graph_of(spark, functions, calls):
    """functions (file, name, line); calls (file, line, caller, callee or None)."""
    nodes = [(f"func:{f}:{n}:{at}", "Function", n, None, f, at) for f, n, at in functions]
    edges = []
    for i, (f, at, caller, callee) in enumerate(calls):
        nodes.append((f"callsite:{i}", "Callsite", "x", None, f, at))
        edges.append((next(n[0] for n in nodes if n[2] == caller and n[4] == f), "CALLS", f"callsite:{i}"))
        if callee:
            nodes.append((f"sym:{callee}", "Symbol", callee, None, f, None))
            edges.append((f"callsite:{i}", "CALLS_TARGET", f"sym:{callee}"))
    return spark.createDataFrame(list(dict.fromkeys(nodes)), NODES), spark.createDataFrame(edges, "src string, rel string, dst string")


def test_program_of_known_calls(spark):
    functions = [("a", "f", 1), ("a", "g", 5), ("a", "h", 9), ("a", "h", 12), ("b", "f", 1)]
    calls = [("a", 2, "f", "h"), ("a", 6, "g", "h"), ("a", 7, "g", "nowhere"), ("a", 13, "h", None), ("b", 2, "f", "g"), ("b", 3, "f", "f")]
    p = interprocedural.program(*graph_of(spark, functions, calls))
    got = {(r.src, r.dst, r.rel) for r in p.branches.collect()}
    assert got == {
        ("bb:a:f:1", "bb:a:h:12", "NEXT"), ("bb:a:g:5", "bb:a:h:12", "NEXT"), ("bb:a:g:5", "bb:a:nowhere:0", "UNKNOWN_BRANCH"), ("bb:a:h:12", "bb:a:unknown:0", "UNKNOWN_BRANCH"),
        ("bb:b:f:1", "bb:b:g:0", "NEXT"), ("bb:b:f:1", "bb:b:f:1", "NEXT"),
    }
    assert [(r.block, r.preds) for r in p.merges.collect()] == [("bb:a:h:12", ["bb:a:f:1", "bb:a:g:5"])]
    t = p.totals.first()
    assert (t.functions, t.unresolved, t.unknown_branches, t.phis, t.strength) == (5, 2, 2, 1, 100 - 30 - 2)
    nodes, edges = interprocedural.graph_rows(p, "s")
    assert {r.label: r.n for r in nodes.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"ResolutionNode": 5, "CFGBlock": 5}
    found = {(r.src, r.rel, r.dst) for r in edges.collect()}
    # a resolution edge needs a function of the name on the call's line, a branch two known blocks
    assert {r for r in found if r[1] == "NEXT"} == {("bb:a:f:1", "NEXT", "bb:a:h:12"), ("bb:a:g:5", "NEXT", "bb:a:h:12"), ("bb:b:f:1", "NEXT", "bb:b:f:1")}
    assert sum(r[1] == "HAS_SYMBOL_RESOLUTION" for r in found) == 5 and not any(r[1].startswith("CALLS") for r in found)
    few = interprocedural.graph_rows(p, "s", most_functions=5)[0]
    assert {r.label for r in few.select("label").distinct().collect()} == {"CFGBlock"}
    assert interprocedural.program(*graph_of(spark, functions, calls), most_blocks=2).blocks.count() == 2


def test_prepared_statements_count_in_the_sources_file(spark):
    rows = [
        ("a", 1, 0, "s", "Source", None, "", "$_GET", False), ("a", 4, 1, "p", "Sanitizer", "SQL_PREPARE", "", "", False), ("b", 3, 0, "k3", "Sink", "SQL", "", "", False),
        ("b", 5, 1, "k5", "Sink", "SQL", "", "", False), ("b", 2, 2, "q", "Sanitizer", "SQL_PREPARE", "", "", False),
    ]
    p = interprocedural.program(*graph_of(spark, [("a", "f", 1)], [("a", 2, "f", None)]))
    got = {r.dst: r for r in interprocedural.edges_between_files(spark.createDataFrame(rows, FACTS), p).collect()}
    assert {k: r.prepared for k, r in got.items()} == {"k3": False, "k5": True}
    assert all((r.file, r.via, r.constraint_strength, r.unresolved_calls) == ("a", "interprocedural", 69.0, 1) for r in got.values())
    found = rules.flow_findings(spark.createDataFrame(rows, FACTS).transform(lambda d: interprocedural.edges_between_files(d, p)), rules.FLOW_RULES["RULE-SQLI-001"]).collect()
    assert [r.sink_line for r in found] == [3]


FILES = [
    ("a/in.php", "<?php\n$v = $_GET['v'];\n$w = $_POST['w'];\n"),
    ("b/out.php", "<?php\n\n\n\nmysqli_query($c, $q);\necho $v;\nreadfile(ABSPATH . $f);\n"),
    ("c/lib.js", "function go(a) { return helper(a); }\n"),
]


def test_a_scan_finds_flows_between_files(spark, tmp_path):
    files = spark.createDataFrame(FILES, "rel_path string, text string").withColumn("size", F.octet_length("text").cast("long"))
    assert scan(files, "s", "generic-php", keep=False).findings.count() == 0
    s = scan(files, "s", "generic-php", options=Options(interprocedural=True), work=str(tmp_path))
    rows = {(r.file, r.rule_id, r.sink_line): r for r in s.enriched.collect()}
    assert set(rows) == {("a/in.php", "RULE-SQLI-001", 5), ("a/in.php", "RULE-XSS-001", 6)}
    w = rows["a/in.php", "RULE-SQLI-001", 5].witness
    assert w.analysis_limits == ["exposure_not_gated", "coarse_taint_approximation", "interprocedural_heuristic", "dynamic_call_resolution_incomplete"]
    assert w.semantic_trace[-1] == "interprocedural_taint_approximation" and "lift_derived_flow" not in w.semantic_trace
    assert (w.constraint_summary.constraint_strength, w.constraint_summary.unresolved_calls, w.constraint_summary.source_count) == (69.0, 1, 2)
    rels = {r.rel: r.n for r in s.edges.groupBy("rel").agg(F.count("*").alias("n")).collect()}
    assert rels["CAN_REACH_SINK"] == rels["FLOWS_TO"] == 4
    assert s.integrity.first().ok and s.nodes.where("label = 'CFGBlock'").select("layer").distinct().first().layer == "L3_FEATURE_FLOW"


def test_a_broken_graph_lowers_the_score(spark):
    from factspark.operators import enrich, graph

    nodes = spark.createDataFrame([("a", "Source"), ("b", "Sink")], "id string, label string").withColumn("layer", graph.layer(F.col("label")))
    edges = graph.layered_edges(nodes, spark.createDataFrame([("a", "FLOWS_TO", "b"), ("a", "FLOWS_TO", "gone")], "src string, rel string, dst string"))
    r = graph.integrity(nodes, edges).first()
    assert (r.ok, r.dangling, r.misplaced) == (False, 1, 0)
    f = facts_of(spark, 1)[1]
    found = rules.flow_findings(flows.flows(f), rules.FLOW_RULES["RULE-XSS-001"])
    whole, broken = (enrich.enriched(found, integrity_ok=x).select("finding_id", "score").orderBy("finding_id").collect() for x in (True, graph.integrity(nodes, edges).select("ok").scalar()))
    assert len(whole) and all(a.score - b.score == pytest.approx(0.15) or b.score == 0 for a, b in zip(whole, broken, strict=True))
