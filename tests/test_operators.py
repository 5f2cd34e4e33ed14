"""Operators on small, hand-built inputs, with results worked out by hand."""

import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from factspark.functions import scalars as S
from factspark.operators import enrich, facts, flows, graph, report, rules
from factspark.operators.lift import lift, spans_of
from factspark.sources import archives, files, packs, sinks

FACTS = "file string, line int, ord long, id string, label string, kind string, context string, name string, static boolean"


#: Small programs.
SAMPLES = [
    ("db.php", "php", "<?php\n// reads one row\n$id = $_GET['id'];\n$rows = $db->query(\"SELECT * FROM t WHERE id = $id\");\nfunction show($r) {\n  echo htmlspecialchars($r['name']);\n  include 'foot.php';\n}\nshow($rows);\n?>\n<p>done</p>\n<?php class Box { public function get($k) { return Store::read($k, strlen('a(b')); } }\n"),
    ("app.js", "javascript", "class A { run(x) { return load(x, () => x.then(y)); } }\nfunction go(a) { /* a( */ return fetch(a).then(r => r.json()); }\n"),
    ("page.html", "html", "<html><body><ul><li>a</li><li>b</li></ul><p>x</p></body></html>"),
    ("broken.php", "php", "<?php function f( { echo $x; "),
    ("note.txt", "other", "f(x)"),
]


def fact(file, line, ord_, label, kind="HTTP_SUPERGLOBAL", context="", name="$_GET", static=False):
    return (file, line, ord_, f"n{ord_}", label, kind, context, name, static)


def test_nearest_source_is_the_last_at_or_above(spark):
    f = spark.createDataFrame([fact("a", 10, 1, "Source"), fact("a", 20, 2, "Source"), fact("a", 30, 3, "Source"), fact("a", 50, 4, "Sink", "FILE_INCLUDE"), fact("a", 60, 5, "Source")], FACTS)
    assert [(r.src, r.dst, r.source_line, r.sink_line) for r in flows.flows(f).collect()] == [("n3", "n4", 30, 50)]


def test_of_sources_on_one_line_the_first_wins(spark):
    f = spark.createDataFrame([fact("a", 5, 2, "Source"), fact("a", 5, 1, "Source"), fact("a", 5, 3, "Sink", "HTML")], FACTS)
    assert flows.flows(f).first().src == "n1"


def brute_flows(rows):
    fits = {"SQL": lambda x: x[6] == "SQL" or x[5] == "SQL_PREPARE", "HTML": lambda x: x[6] in ("HTML", "GENERIC"), "REDIRECT": lambda x: x[6] in ("URL", "GENERIC") or x[7] in facts.URL_SANITIZERS, "HTTP_CLIENT": lambda x: x[6] in ("URL", "GENERIC")}
    out = set()
    for k in (r for r in rows if r[4] == "Sink"):
        above = [s for s in rows if s[4] == "Source" and s[0] == k[0] and s[1] <= k[1]]
        if above:
            s = min(above, key=lambda s: (-s[1], s[2]))
            if not any(x[4] == "Sanitizer" and x[0] == k[0] and s[1] < x[1] <= k[1] and fits.get(k[5], lambda x: False)(x) for x in rows):
                out.add((s[3], k[3]))
    return out


def test_flows_equal_a_loop_and_ignore_partitioning(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        label = rng.choice(["Source", "Source", "Sink", "Sanitizer", "Other"])
        kind = rng.choice(["SQL", "HTML", "REDIRECT", "HTTP_CLIENT", "CODE_EXEC"]) if label == "Sink" else rng.choice(["SANITIZE", "SQL_PREPARE"])
        rows.append(fact(f"f{rng.randrange(12)}", rng.randrange(1, 15), i, label, kind, rng.choice(["SQL", "HTML", "URL", "GENERIC", "UNKNOWN"]), rng.choice(["esc_url", "x"])))
    want = brute_flows(rows)
    rng.shuffle(rows)
    for parts in (1, 7):
        got = {(r.src, r.dst) for r in flows.flows(spark.createDataFrame(rows, FACTS).repartition(parts), cap=None).collect()}
        assert got == want


def test_cap_takes_the_first_sinks_of_a_file(spark):
    f = spark.createDataFrame([fact("a", 1, 0, "Source")] + [fact("a", 10 - i, i, "Sink", "HTML") for i in range(1, 6)], FACTS)
    assert sorted(r.sink_line for r in flows.flows(f, cap=2).collect()) == [5, 6]


def test_cross_file_pairs_equal_a_full_product(spark):
    rng = random.Random(5)
    rows = [fact(f"f{rng.randrange(4)}", rng.randrange(9), i, rng.choice(["Source", "Sink"]), "HTTP_SUPERGLOBAL", static=rng.random() < 0.2) for i in range(80)]
    rows = [r if r[4] == "Source" else (*r[:5], rng.choice(["SQL", "HTML", "CSV_OUTPUT"]), *r[6:]) for r in rows]
    pairs = [(s, k) for s in rows for k in rows if s[4] == "Source" and k[4] == "Sink" and not k[8] and k[5] != "CSV_OUTPUT" and s[0] != k[0]]
    pairs.sort(key=lambda p: (p[0][0], p[0][1], p[0][2], p[1][0], p[1][1], p[1][2]))
    for cap in (1, 7, 60, 10_000):
        got = [(r.src, r.dst) for r in flows.cross_file_flows(spark.createDataFrame(rows, FACTS), cap).collect()]
        assert got == [(s[3], k[3]) for s, k in pairs[:cap]]


def test_a_finding_of_a_small_script_has_the_known_score(spark):
    f = spark.createDataFrame([fact("a", 3, 1, "Source"), fact("a", 4, 2, "Sink", "SQL")], FACTS)
    found = rules.flow_findings(flows.flows(f), rules.FLOW_RULES["RULE-SQLI-001"])
    r = enrich.enriched(found, "generic-php").first()
    assert (r.source_line, r.sink_line, r.severity, r.skeptic.verdict, r.verification, round(r.score, 6), r.bucket) == (3, 4, "MEDIUM", "DOWNGRADE", "INCONCLUSIVE", 0.058, "VERY_LOW")
    assert round(enrich.enriched(found).first().score, 6) == 0.008


def test_witness_hash_is_that_of_canonical_json(spark):
    f = spark.createDataFrame([fact("a", 3, 1, "Source"), fact("a", 4, 2, "Sink", "HTML")], FACTS)
    r = rules.flow_findings(flows.flows(f), rules.FLOW_RULES["RULE-XSS-001"]).first()
    w = {k: v for k, v in r.witness.asDict(recursive=True).items()}
    w["constraint_summary"] = {k: v for k, v in w["constraint_summary"].items() if v is not None}
    text = json.dumps(w, sort_keys=True, separators=(",", ":"))
    assert r.finding_id == f"FINDING|RULE-XSS-001|n2|n2|{hashlib.sha256(text.encode()).hexdigest()[:16]}"
    assert found_ok(spark, r.finding_id)


def found_ok(spark, ident):
    return spark.range(1).select(S.valid_finding_id(F.lit(ident))).first()[0]


def test_static_includes_are_no_finding(spark):
    for static, n in ((True, 0), (False, 1)):
        f = spark.createDataFrame([fact("a", 5, 1, "Source"), fact("a", 10, 2, "Sink", "FILE_INCLUDE", static=static)], FACTS)
        assert rules.flow_findings(flows.flows(f), rules.FLOW_RULES["RULE-LFI-001"]).count() == n


def test_same_line_flows_are_gated(spark):
    f = spark.createDataFrame([fact("a", 2, 0, "Source"), fact("a", 5, 1, "Source"), fact("a", 5, 2, "Sink", "HTML")], FACTS)
    assert flows.flows(f).count() == 1
    assert rules.flow_findings(flows.flows(f), rules.FLOW_RULES["RULE-XSS-001"]).count() == 0


def test_lexer_to_findings(spark):
    ir = lift(spark.createDataFrame(SAMPLES, "file string, language string, text string"))
    rows = {(r.file, r.kind): r for r in ir.collect()}
    assert ("db.php", "method_declaration") in rows and ("db.php", "include_expression") in rows and ("app.js", "class_declaration") in rows
    assert any(r.file == "broken.php" and r.diagnostic == "SYNTAX_ERROR" for r in ir.collect())
    assert not any(r.file == "note.txt" for r in ir.collect())
    found = facts.deduped(facts.pattern_facts(ir.where("kind is not null").select("file", F.col("start_line").alias("line"), F.col("start_byte").alias("byte_off"), F.col("label").alias("text")), facts.merged(facts.GENERIC, facts.PLATFORM)))
    assert {r.kind for r in found.where("label = 'Sink'").collect()} >= {"SQL", "HTML", "FILE_INCLUDE"}
    line = spark.createDataFrame([("a.php", 3, 0, "$id = $_GET['id'];"), ("a.php", 4, 0, "$db->query($id);")], "file string, line int, byte_off int, text string")
    f = facts.deduped(facts.pattern_facts(line, facts.GENERIC)).withColumns({"ord": F.col("line").cast("long"), "id": F.concat_ws(":", "label", F.col("line").cast("string")), "static": F.col("static_arg")})
    assert [(r.source_line, r.sink_line) for r in rules.flow_findings(flows.flows(f), rules.FLOW_RULES["RULE-SQLI-001"]).collect()] == [(3, 4)]


def test_built_in_patterns_on_texts_that_tell_them_apart(spark):
    said = {
        "PDO :: query($q)": [("Sink", "SQL", "pdo_static_query")], "$tpl->prepare($x)": [], "(new PDO($d))->prepare($q)": [("Sanitizer", "SQL_PREPARE", "")],
        "$db -> query ($q)": [("Sink", "SQL", "pdo_query")], "my_include ($x)": [], "include_once $x": [("Sink", "FILE_INCLUDE", "")], "printf ($x)": [("Sink", "HTML", "")], "fprintf($f, $x)": [],
        "fopen('php://input', 'r')": [("Source", "HTTP_BODY", ""), ("Sink", "REMOTE_READ", "")], "xphp://input": [], "$_files": [], "$_FILES": [("Source", "HTTP_UPLOAD", "")],
    }
    texts = spark.createDataFrame([(str(i), 1, 0, t) for i, t in enumerate(said)], "file string, line int, byte_off int, text string")
    got = {t: [] for t in said}
    for r in facts.pattern_facts(texts, facts.GENERIC).orderBy("seq").collect():
        got[r.text].append((r.label, r.kind, r.api))
    assert got == said


def test_heuristics_look_at_files_as_a_whole(spark):
    one = ["$x = $_REQUEST[", "'option' ]; if ('get' ===", "$_SERVER['REQUEST_METHOD']) {", "wp_verify_nonce($n);"]
    rows = [("a.php", i + 1, 0, t) for i, t in enumerate(one)] + [("b.php", i + 1, 0, t) for i, t in enumerate(one[:3])] + [("c.php", i + 1, 0, t.upper()) for i, t in enumerate(one)]
    d = spark.createDataFrame(rows, "file string, line int, byte_off int, text string")
    assert [(r.file, r.pattern, r.line) for r in facts.heuristics(d).collect()] == [("a.php", "NONCE_GET_ONLY", 1)]


def test_only_required_files_of_a_fixed_folder_are_static(spark):
    edges = spark.createDataFrame([(f, 5) for f in "abcd"], "file string, sink_line int")
    calls = spark.createDataFrame([("a", 5, "require_once __DIR__ . $x"), ("b", 5, "include __DIR__ . $x"), ("c", 5, "include plugin_dir_path($f)"), ("d", 6, "require __DIR__ . $x")], "file string, line int, label string")
    assert sorted(r.file for r in rules.without_static_includes(edges, calls).collect()) == ["b", "d"]


def test_a_prepared_statement_stops_the_rule(spark):
    lines = [("a.php", 1, "$id = $_GET['id'];"), ("a.php", 2, "$s = (new PDO($d))->prepare($q);"), ("a.php", 3, "$db->query($id);"), ("b.php", 1, "$id = $_GET['id'];"), ("b.php", 2, "$tpl->prepare($q);"), ("b.php", 3, "$db->query($id);")]
    d = spark.createDataFrame([(f, n, 0, t) for f, n, t in lines], "file string, line int, byte_off int, text string")
    f = facts.deduped(facts.pattern_facts(d, facts.GENERIC)).withColumns({"ord": F.col("line").cast("long"), "id": F.concat_ws(":", "file", "line"), "static": F.col("static_arg")})
    near = flows.nearest_sources(f)
    assert {(r.file, r.prepared) for r in near.collect()} == {("a.php", True), ("b.php", False)}
    assert [r.file for r in rules.flow_findings(near, rules.FLOW_RULES["RULE-SQLI-001"]).collect()] == ["b.php"]
    assert [(r.dst, r.src) for r in flows.protects(f).collect()] == [("a.php:3", "a.php:2")]


def test_lexer_budget_keeps_declarations():
    text = "<?php function a() { b(); c(); } function d() { e(); }"
    rows, problem = spans_of(text, "php", "x", budget=2)
    assert problem == "IR_BUDGET_EXCEEDED" and {r[1] for r in rows} == {"function_definition"}


def test_catalogs_merge_and_contexts(spark):
    assert len(facts.merged(facts.GENERIC, facts.GENERIC)) == len(facts.merged(facts.GENERIC))
    d = spark.createDataFrame([("esc_html(x)",), ("intval($_GET[a])",), ("esc_url_raw(x)",), ("sanitize_text_field(a)",), ("foo(b)",)], "t string")
    got = [r[0] for r in d.select(facts.sanitizer_context(facts.call_name(F.col("t")))).collect()]
    assert got == ["HTML", "GENERIC", "HTML", "URL", "UNKNOWN"]


def test_upsert_keeps_the_last_row_and_the_first_place(spark):
    d = spark.createDataFrame([("x", 1, "a"), ("y", 2, "b"), ("x", 3, "c")], "id string, seq int, v string")
    assert {(r.id, r.v, r.ord) for r in facts.upserted(d, "id", "seq").collect()} == {("x", "c", 1), ("y", "b", 2)}


def test_groups_collapse_one_sink(spark):
    rows = [("i1", "RULE-LFI-001", "MEDIUM", "a.php", 47, 23, 0.1, "VERY_LOW", True, False), ("i2", "RULE-LFI-001", "MEDIUM", "a.php", 47, 31, 0.5, "MEDIUM", True, False), ("i3", "RULE-XSS-001", "LOW", "b.php", 10, 5, 0.3, "LOW", False, False)]
    d = spark.createDataFrame(rows, "finding_id string, rule_id string, severity string, file string, sink_line int, source_line int, score double, bucket string, downgraded boolean, blocked boolean")
    got = {r.rule_id: r for r in report.summary_groups(d).collect()}
    assert len(got) == 2 and got["RULE-LFI-001"].n == 2 and got["RULE-LFI-001"].sample_source_lines == [23, 31] and got["RULE-LFI-001"].n_medium == 1
    assert report.summary_groups(d).where(report.passes_triage(0.0, "MEDIUM", False)).count() == 1
    assert report.summary_groups(d).where(report.passes_triage(0.0, "LOW", False)).count() == 2


def test_calls_resolve_by_name(spark):
    calls = spark.createDataFrame([("h", "dangerous_fn"), ("h", "nowhere")], "caller string, callee string")
    got = {r.callee: r.resolution for r in graph.resolve_calls(calls, spark.createDataFrame([("dangerous_fn",)], "name string")).collect()}
    assert got == {"dangerous_fn": "STATIC", "nowhere": "UNKNOWN"}


def test_signals_layers_and_integrity(spark):
    f = spark.createDataFrame([fact("a", i, i, "Sink", k) for i, k in enumerate(["OBJECT_INJECTION", "CODE_EXEC", "UPLOAD", "SQL"])], FACTS)
    assert graph.signals(f).count() == 3
    nodes = spark.createDataFrame([("f", "File"), ("s", "Sink")], "id string, label string")
    edges = spark.createDataFrame([("f", "HAS_SINK", "s"), ("s", "FLOWS_TO", "gone")], "src string, rel string, dst string")
    n, e = graph.with_layers(nodes, edges)
    assert {r.dst: r.layer for r in e.collect()} == {"s": "L4_SECURITY", "gone": "L4_SECURITY"}
    assert [r.problem for r in graph.dangling(n, e).collect()] == ["dangling_dst"]
    assert {r.problem for r in graph.layer_problems(n, e).collect()} == {"incomplete_layers"}


def test_engine_gates_and_dedupes(spark):
    one = lambda which: spark.createDataFrame([("F1", "A"), ("F2", "A"), ("F1", "B")], "finding_id string, rule_id string")
    pack = [rules.Rule("A", "LOW", "one"), rules.Rule("B", "HIGH", "one"), rules.Rule("C", "LOW", "one", enabled=False), rules.Rule("D", "LOW", "one", min_schema="4"), rules.Rule("E", "LOW", "one", adapter="wp"), rules.Rule("G", "LOW", "none")]
    out, told = rules.evaluate(spark, pack, {"one": one})
    assert dict(told) == {"A": "OK", "B": "OK", "C": "RULE_DISABLED", "D": "RULE_SKIPPED_SCHEMA", "E": "RULE_SKIPPED_ADAPTER", "G": "NO_EVALUATOR"}
    assert {(r.finding_id, r.rule_id, r.severity) for r in out.collect()} == {("F1", "B", "HIGH"), ("F2", "A", "LOW")}


def test_scalars(spark):
    one = spark.range(1)
    sizes = [(16, 24, 12), (4, 16, 2), (1, 1, 1)]
    for cpus, ram, n in sizes:
        assert one.select(S.workers(F.lit(cpus), F.lit(ram))).first()[0] == n
    assert [one.select(S.in_flight(F.lit(w), F.lit(r))).first()[0] for w, r in ((12, 24), (0, 1), (4, 16), (16, 4))] == [24, 1, 8, 16]
    assert [one.select(S.at_least(F.lit(a), F.lit(b))).first()[0] for a, b in (("2", "1"), ("2", "2"), ("1", "2"), ("10", "3.1"))] == [True, True, False, False]
    assert one.select(S.redact(F.lit("x token = abc y"))).first()[0] == "x [REDACTED] y"
    assert one.select(S.repository(F.lit("https://example.com/o/r.git"))).first()[0] == "o/r"
    assert one.select(S.escaped(F.lit("<a&b>"))).first()[0] == "&lt;a&amp;b&gt;"
    got = one.select(S.matches_glob(F.lit("x/vendor/y.js"), ["**/vendor/**"]), S.matches_glob(F.lit("vendor/y.js"), ["**/vendor/**"])).first()
    assert tuple(got) == (True, False)
    assert one.select(S.edge_id(F.lit("a"), F.lit("R"), F.lit("b"))).first()[0] == "e:" + hashlib.sha256(b"a\0R\0b\0{}").hexdigest()[:16]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.php").write_bytes(b"<?php echo 1;")
    (tmp_path / "b.bin").write_bytes(b"\0\xff")
    rows = {r.rel_path: r for r in files.read_tree(spark, str(tmp_path)).withColumns({"binary": files.is_binary(F.col("content")), "encoding": files.decoded(F.col("content"), 100)[1]}).collect()}
    assert set(rows) == {"sub/a.php", "b.bin"} and rows["b.bin"].binary and not rows["sub/a.php"].binary
    assert rows["b.bin"].encoding == "latin-1" and rows["sub/a.php"].encoding == "utf-8"
    d = spark.createDataFrame([(f"p{i:02d}/x.php", 10) for i in range(20)], "rel_path string, size long")
    got = files.within_quotas(d, files.Quotas(max_files=15, max_total_bytes=100))
    assert got.where("status = 'kept'").count() == 10 and got.where("status = 'MAX_FILES'").count() == 5
    w = spark.createDataFrame([("a/b/x.php", "php"), ("a/c/y.php", "php"), ("a/c/z.php", "php"), ("r.js", "javascript")], "rel_path string, language string")
    assert files.wrapper_root(w).first().root == "a/c"


def test_archives_and_broken_ones(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("../up/a.php", "<?php")
        z.writestr("d/b.js", "x")
    d = spark.createDataFrame([("x.zip", data.getvalue()), ("y.zip", b"no zip")], "path string, content binary")
    rows = archives.read_archives(d).collect()
    assert {r.rel_path for r in rows if not r.error} == {"up/a.php", "d/b.js"} and [r.archive for r in rows if r.error] == ["y.zip"]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("b", None), ("a", "x")], "id string, label string")
    sinks.write_json_lines(nodes, str(tmp_path / "n"), "id")
    text = "".join(p.read_text() for p in sorted((tmp_path / "n").glob("part-*")))
    assert text == '{"id":"a","label":"x"}\n{"id":"b"}\n'
    assert sorted(r.label or "" for r in sinks.upsert(nodes, spark.createDataFrame([("a", "y")], nodes.schema), "id").collect()) == ["", "y"]


def test_empty_inputs(spark):
    f = spark.createDataFrame([], FACTS)
    assert flows.flows(f).count() == 0 and flows.cross_file_flows(f).count() == 0 and graph.signals(f).count() == 0
