"""Rules over flows and facts: gates, one finding per sink, witnesses, and an engine that runs a pack."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .catalog_values import STATIC_INCLUDE_CALL

PRIMARY = ("$_GET", "$_POST", "$_REQUEST")


@dataclass(frozen=True)
class FlowRule:
    """A rule on flows, as one row of data: what it looks at, its gates, what its findings say."""

    id: str
    sink_kind: str
    severity: str
    title: str
    labels: tuple[str, ...]
    non_static: bool = False
    primary: bool = False
    unprepared: bool = False
    one_per_sink: bool = True


#: The rules on flows, with their severity, title key and labels.
FLOW_RULES = {
    r.id: r
    for r in (
        FlowRule("RULE-SQLI-001", "SQL", "MEDIUM", "sqli.graph_flow", ("HTTP_SUPERGLOBAL", "SQL"), unprepared=True),
        FlowRule("RULE-XSS-001", "HTML", "LOW", "xss.graph_flow", ("HTTP_SUPERGLOBAL", "HTML")),
        FlowRule("RULE-REDIRECT-001", "REDIRECT", "MEDIUM", "redirect.graph_flow", ("HTTP_SUPERGLOBAL", "REDIRECT")),
        FlowRule("RULE-LFI-001", "FILE_INCLUDE", "MEDIUM", "lfi.graph_flow", ("FILE_INCLUDE",), non_static=True),
        FlowRule("RULE-RFI-001", "REMOTE_READ", "HIGH", "rfi.graph_flow", ("REMOTE_READ",), non_static=True),
        FlowRule("RULE-RCE-001", "CODE_EXEC", "CRITICAL", "rce.graph_flow", ("CODE_EXEC",), primary=True),
        FlowRule("RULE-UPLOAD-001", "UPLOAD", "HIGH", "upload.graph_flow", ("UPLOAD",), non_static=True),
        FlowRule("RULE-SSRF-001", "HTTP_CLIENT", "LOW", "ssrf.graph_flow", ("SSRF",)),
        FlowRule("RULE-CSV-001", "CSV_OUTPUT", "LOW", "csv.graph_flow", ("CSV",)),
    )
}


def passes() -> Column:
    """The gates of the rule in a row's rule columns: not on one line, a dynamic sink, a primary source, no prepared statement on the way."""
    other_line = ~((F.col("source_line") == F.col("sink_line")) & (F.col("source_line") > 0))
    dynamic = ~F.col("rule.non_static") | ~F.coalesce("sink_static", F.lit(False))
    return other_line & dynamic & (~F.col("rule.primary") | F.coalesce(F.col("source_name").isin(*PRIMARY), F.lit(False))) & (~F.col("rule.unprepared") | ~F.col("prepared"))


def _flag(rows: DataFrame, name: str, kind: str) -> Column:
    """A column that only flows between files have, else null."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def with_witness(rows: DataFrame, labels: Column, more_limits: tuple[str, ...] = ()) -> DataFrame:
    """rows (flows with n and alternates) with witness. Its fields stand in alphabetical order, so that its JSON is canonical; what is
    null is left out."""
    between, unresolved = _flag(rows, "via", "string") == "interprocedural", _flag(rows, "unresolved_calls", "int")
    between = F.coalesce(between, F.lit(False))
    part = lambda when, *names: F.when(when, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    trace = F.concat(
        F.array(F.concat(F.lit("graph:source:"), "src"), F.concat(F.lit("graph:sink:"), "dst")),
        F.transform("alternates", lambda x: F.concat(F.lit("graph:alt_source:"), x)),
        part(~between, "lift_derived_flow"),
        part(between, "interprocedural_taint_approximation"),
    )
    limits = F.concat(
        F.array(F.lit("exposure_not_gated")),
        part(between, "coarse_taint_approximation", "interprocedural_heuristic"),
        part(F.coalesce(unresolved, F.lit(0)) > 0, "dynamic_call_resolution_incomplete"),
        F.array(*map(F.lit, more_limits)).cast("array<string>"),
    )
    summary = F.struct(
        F.lit(True).alias("approximate_flow"),
        _flag(rows, "constraint_strength", "double").alias("constraint_strength"),
        F.when(F.col("n") > 1, F.col("n")).alias("source_count"),
        F.when((F.col("sink_kind") == "SQL") & F.col("prepared"), F.lit(True)).alias("sql_prepare_on_path"),
        unresolved.alias("unresolved_calls"),
    )
    witness = F.struct(
        limits.alias("analysis_limits"),
        summary.alias("constraint_summary"),
        F.array(F.concat_ws("|", "src", F.lit("FLOWS_TO"), "dst")).alias("path_edges"),
        trace.alias("semantic_trace"),
        F.array(F.struct(F.lit("FLOWS_TO").alias("edge_kind"), F.col("src").alias("from_id"), F.col("dst").alias("to_id"))).alias("summary_hops"),
        labels.alias("taint_labels"),
    )
    return rows.withColumn("witness", witness)


def one_per_sink(edges: DataFrame, most_alternates: int = 5, keys: tuple[str, ...] = ("file", "sink_line")) -> DataFrame:
    """The first edge (by sink_ord) of each file and sink line, with count and the sources of the next few edges."""
    cols = [c for c in edges.columns if c not in keys]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sink_ord", "src"))), lambda x: x["src"])
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*cols), "sink_ord").alias("first"), F.count("*").alias("n"), F.slice(ordered, 2, most_alternates).alias("alternates")).select(*keys, "first.*", "n", "alternates")


def flow_findings(edges: DataFrame, rule: FlowRule, grouped: bool = True) -> DataFrame:
    """Findings of a rule over edges that pass its gates: one per sink line, or (not grouped) one per edge."""
    return all_flow_findings(edges, [replace(rule, one_per_sink=grouped)])


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a constant of the plan."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{schema}>>")))


def all_flow_findings(edges: DataFrame, chosen: list[FlowRule]) -> DataFrame:
    """Findings of flow rules from one pass over the edges: the rules are a table (as long as a pack, which the driver holds) that
    edges meet by sink kind, and its columns say which gates hold, so a pack's parameters need no code."""
    schema = "id string, sink_kind string, severity string, title string, labels array<string>, non_static boolean, primary boolean, unprepared boolean, one_per_sink boolean"
    table = _literal(edges.sparkSession, [(r.id, r.sink_kind, r.severity, r.title, list(r.labels), r.non_static, r.primary, r.unprepared, r.one_per_sink) for r in chosen], schema)
    table = table.select(F.col("sink_kind").alias("_kind"), F.col("id").alias("rule_id"), F.struct(*table.columns).alias("rule"))
    rows = edges.join(F.broadcast(table), F.col("sink_kind") == F.col("_kind")).drop("_kind").where(passes())
    each = rows.where(~F.col("rule.one_per_sink")).withColumns({"n": F.lit(1).cast("long"), "alternates": F.lit([]).cast("array<string>")})
    parts = [one_per_sink(rows.where("rule.one_per_sink"), keys=("rule_id", "file", "sink_line"))] if any(r.one_per_sink for r in chosen) or not chosen else []
    parts += [each] if any(not r.one_per_sink for r in chosen) else []
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = with_witness(rows, F.col("rule.labels"))
    ident = S.finding_id(F.col("rule_id"), F.when(F.col("rule.one_per_sink"), F.col("dst")).otherwise(F.col("src")), F.col("dst"), S.sha(S.canonical(F.to_json("witness")), 16))
    return rows.select(ident.alias("finding_id"), "rule_id", F.col("rule.severity").alias("severity"), F.col("rule.title").alias("title_key"), "file", "source_line", "sink_line", "src", "dst", "n", "witness")


@dataclass(frozen=True)
class NodeRule:
    """A rule on single nodes: what its findings say."""

    id: str
    severity: str
    title: str
    labels: tuple[str, ...]
    trace: str
    strength: int | None = None


#: The rules on nodes, and the rule on flows without an ownership check.
NODE_RULES = {
    r.id: r
    for r in (
        NodeRule("RULE-OBJINJ-001", "MEDIUM", "php.object_injection.signal", ("DESERIALIZE",), "security_signal", 35),
        NodeRule("RULE-WP-NONCE-001", "MEDIUM", "wp.nonce_get_only", ("WP_NONCE", "METHOD_GUARD_GET_ONLY"), "pattern"),
        NodeRule("RULE-WP-AJAX-001", "HIGH", "wp.ajax_nopriv_no_cap", ("AJAX_NOPRIV",), "ajax"),
        NodeRule("RULE-WP-REST-001", "HIGH", "wp.rest_weak_permission", ("REST", "ACCESS_CONTROL"), "route"),
    )
}
IDOR = FlowRule("RULE-WP-IDOR-001", "", "MEDIUM", "wp.idor.graph_heuristic", ("IDOR", "HTTP_SUPERGLOBAL"))
IDOR_LIMIT, IDOR_KINDS = "idor_heuristic_no_object_ownership_model", ("SQL", "HTML", "OBJECT_INJECTION")


def node_findings(nodes: DataFrame, rule: NodeRule) -> DataFrame:
    """Findings of nodes (id, file, line): the node is anchor, path and trace. They have one line, so source_line is null."""
    hops = F.array().cast("array<struct<edge_kind:string,from_id:string,to_id:string>>")
    summary = lambda kind: F.struct(F.lit(None).cast("boolean").alias("approximate_flow"), F.lit(rule.strength).cast(kind).alias("constraint_strength"), F.lit(None).cast("long").alias("source_count"), F.lit(None).cast("boolean").alias("sql_prepare_on_path"), F.lit(None).cast("int").alias("unresolved_calls"))
    fields = lambda kind: (F.array().cast("array<string>").alias("analysis_limits"), summary(kind).alias("constraint_summary"), F.array("id").alias("path_edges"), F.array(F.concat(F.lit(f"graph:{rule.trace}:"), "id")).alias("semantic_trace"), hops.alias("summary_hops"), F.array(*map(F.lit, rule.labels)).alias("taint_labels"))
    # a node's strength is a whole number in the JSON that is hashed, a flow's is not
    rows = nodes.withColumn("witness", F.struct(*fields("double")))
    ident = S.finding_id(F.lit(rule.id), F.col("id"), F.col("id"), S.sha(S.canonical(F.to_json(F.struct(*fields("int")))), 16))
    return rows.select(ident.alias("finding_id"), F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.title).alias("title_key"), "file", F.lit(None).cast("int").alias("source_line"), F.coalesce("line", F.lit(1)).alias("sink_line"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1).cast("long").alias("n"), "witness")


def idor_findings(edges: DataFrame, facts: DataFrame, kinds: tuple[str, ...] = IDOR_KINDS) -> DataFrame:
    """One finding per (file, sink line, kind) of a flow to a sink of one of the kinds where no capability is checked."""
    rows = without_capability(edges.where(F.col("sink_kind").isin(*kinds) & (F.col("source_line") != F.col("sink_line"))), facts)
    rows = with_witness(one_per_sink(rows, keys=("file", "sink_line", "sink_kind")), F.array(*map(F.lit, IDOR.labels)), (IDOR_LIMIT,))
    ident = S.finding_id(F.lit(IDOR.id), F.col("dst"), F.col("dst"), S.sha(S.canonical(F.to_json("witness")), 16))
    return rows.select(ident.alias("finding_id"), F.lit(IDOR.id).alias("rule_id"), F.lit(IDOR.severity).alias("severity"), F.lit(IDOR.title).alias("title_key"), "file", "source_line", "sink_line", "src", "dst", "n", "witness")


STATIC_INCLUDE = f"(?i){STATIC_INCLUDE_CALL}"


def without_static_includes(edges: DataFrame, callsites: DataFrame) -> DataFrame:
    """Edges whose sink line has no call (file, line, label) that includes a path fixed in the code."""
    fixed = callsites.where(F.col("label").rlike(STATIC_INCLUDE)).select(F.col("file").alias("f"), F.col("line").alias("l"))
    return edges.join(fixed, (F.col("file") == F.col("f")) & (F.col("sink_line") == F.col("l")), "left_anti")


def heuristic_findings(patterns: DataFrame, pattern: str, rule_id: str) -> DataFrame:
    return patterns.where(F.col("pattern") == pattern).select(F.lit(rule_id).alias("rule_id"), "file", "line")


def with_framework(findings: DataFrame, framework: str) -> DataFrame:
    """Findings stamped with the platform whose profile found them."""
    return findings.withColumn("exposure", F.struct(F.lit("unknown").alias("surface"), F.lit(framework).alias("framework")))


@dataclass(frozen=True)
class Profile:
    id: str
    catalogs: tuple[str, ...]
    adapters: tuple[str, ...]
    pack: str


_BOTH = (("generic", "platform"), ("wordpress",), "full")
PROFILES = {"generic-php": Profile("generic-php", ("generic",), (), "generic-php"), "wordpress": Profile("wordpress", *_BOTH), "full": Profile("full", *_BOTH)}
#: Paths and contents that speak for the platform.
PLATFORM_PATHS = ("wp-load.php", "wp-includes/version.php", "wp-config-sample.php")
PLATFORM_MARKERS = ("ABSPATH", "register_rest_route", "Plugin Name:", "add_action(", "wp_ajax_nopriv_", "$wpdb")


def resolve_profile(profile: str | None, signals: int = 0) -> Profile:
    """A profile by name; auto (or none) is full from two platform signals on, else generic-php; an unknown name is full."""
    name = (profile or "auto").strip().lower()
    if name == "auto":
        name = "full" if signals >= 2 else "generic-php"
    return PROFILES.get(name, PROFILES["full"])


def without_capability(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of files without a capability check."""
    checked = facts.where("label = 'CapabilityCheck' and file is not null").select("file").distinct()
    return rows.join(checked, "file", "left_anti")


def idor(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """One finding per (file, sink line, kind) of a flow to SQL, HTML or object injection where no capability is checked."""
    rows = without_capability(edges.where(F.col("sink_kind").isin(*IDOR_KINDS) & (F.col("source_line") != F.col("sink_line"))), facts)
    return rows.groupBy("file", "sink_line", "sink_kind").agg(F.min_by("src", "sink_ord").alias("src"), F.min_by("dst", "sink_ord").alias("dst"), F.count("*").alias("n"))


def unguarded_ajax(facts: DataFrame, handled_by: DataFrame) -> DataFrame:
    """Unauthenticated actions with no guarded handler, in files without a capability check."""
    actions = facts.where("label = 'AjaxAction'").select("id", "file", "line", "name")
    guarded = handled_by.join(facts.where("label = 'GuardCheck'").select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
    return without_capability(actions.join(guarded, "id", "left_anti"), facts)


def missing_guard_routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes with a MISSING_GUARD edge; their line is unknown and given as 1."""
    routes = nodes.where("label = 'Route'").select("id")
    missing = edges.where("rel = 'MISSING_GUARD'")
    return missing.join(routes, missing["src"] == routes["id"]).select(F.col("src").alias("route"), "dst", F.lit("RULE-WP-REST-001").alias("rule_id"), F.lit(1).alias("line"))


def signal_findings(signals: DataFrame, signal: str, rule_id: str, strength: int) -> DataFrame:
    return signals.where(F.col("signal") == signal).select(F.lit(rule_id).alias("rule_id"), "id", "file", "line", F.lit(strength).alias("constraint_strength"))


@dataclass
class Rule:
    """A pack's entry. evaluator names what gives its findings; params change the gates of a rule on flows."""

    id: str
    severity: str
    evaluator: str
    min_schema: str = "1"
    enabled: bool = True
    adapter: str | None = None
    owasp: list[str] = field(default_factory=list)
    cwe: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    description: str = ""


#: The evaluators of the built-in rules. `flow` is any rule on flows that its params describe.
EVALUATORS = {
    "sqli_graph": "RULE-SQLI-001", "xss_graph": "RULE-XSS-001", "redirect_graph": "RULE-REDIRECT-001", "lfi_graph": "RULE-LFI-001", "rfi_graph": "RULE-RFI-001", "rce_graph": "RULE-RCE-001", "upload_graph": "RULE-UPLOAD-001",
    "ssrf_graph": "RULE-SSRF-001", "csv_graph": "RULE-CSV-001", "object_injection_signal": "RULE-OBJINJ-001", "wp_nonce_get_only": "RULE-WP-NONCE-001", "ajax_nopriv_no_cap": "RULE-WP-AJAX-001", "wp_rest_weak": "RULE-WP-REST-001",
    "wp_idor_graph": "RULE-WP-IDOR-001",
}
FLOW_EVALUATORS = ("flow", *(e for e, i in EVALUATORS.items() if i in FLOW_RULES))


def flow_rule(rule: Rule) -> FlowRule | None:
    """What a pack's rule on flows asks for: the built-in rule of its evaluator with the pack's params, or what params alone describe.
    None for a built-in evaluator under another rule's id, as it gives findings of its own id only."""
    p = rule.params
    if rule.evaluator == "flow":
        base = FlowRule(rule.id, p["sink_kind"], rule.severity, p.get("title", rule.id), tuple(p.get("labels", ())))
    elif EVALUATORS[rule.evaluator] != rule.id:
        return None
    else:
        base = replace(FLOW_RULES[rule.id], severity=rule.severity)
    return replace(
        base,
        sink_kind=p.get("sink_kind", base.sink_kind),
        non_static=p.get("require_non_static_sink", base.non_static),
        primary=p.get("require_primary_sources", base.primary),
        unprepared=p.get("require_unprepared", base.unprepared),
        one_per_sink=p.get("emit_one_per_sink", base.one_per_sink),
    )


#: Standard ids of the built-in rules, as (rule, OWASP, CWE); those of the second list need the platform's adapter.
_GENERIC_IDS = (
    ("RULE-SQLI-001", "A03:2021", "CWE-89"), ("RULE-XSS-001", "A03:2021", "CWE-79"), ("RULE-REDIRECT-001", "A01:2021", "CWE-601"), ("RULE-LFI-001", "A03:2021", "CWE-98"), ("RULE-RFI-001", "A03:2021", "CWE-98"),
    ("RULE-RCE-001", "A03:2021", "CWE-94"), ("RULE-UPLOAD-001", "A03:2021", "CWE-434"), ("RULE-SSRF-001", "A10:2021", "CWE-918"), ("RULE-CSV-001", "A03:2021", None), ("RULE-OBJINJ-001", "A08:2021", "CWE-502"),
)
_PLATFORM_IDS = (("RULE-WP-NONCE-001", "A01:2021", None), ("RULE-WP-AJAX-001", "A01:2021", None), ("RULE-WP-REST-001", "A01:2021", None), ("RULE-WP-IDOR-001", "A01:2021", None))
_SEVERITY = {r.id: r.severity for r in (*FLOW_RULES.values(), *NODE_RULES.values(), IDOR)}


def _pack(ids, adapter: str | None) -> list[Rule]:
    evaluators = {i: e for e, i in EVALUATORS.items()}
    return [Rule(i, _SEVERITY[i], evaluators[i], min_schema="3.1", adapter=adapter, owasp=[o], cwe=[c] if c else []) for i, o, c in ids]


#: Rule packs by name.
PACKS = {"generic-php": _pack(_GENERIC_IDS, None), "wordpress": _pack(_PLATFORM_IDS, "wordpress")}
PACKS["full"] = PACKS["generic-php"] + PACKS["wordpress"]


def gate_status(rules: DataFrame, schema: str, adapters: list[str], evaluators: list[str]) -> DataFrame:
    """rules (id, enabled, min_schema, adapter, evaluator) with status, the first gate that stops a rule, else OK."""
    active = F.col("adapter").isNull() | F.col("adapter").isin(*adapters) if adapters else F.col("adapter").isNull()
    known = F.col("evaluator").isin(*evaluators) if evaluators else F.lit(False)
    status = F.when(~F.col("enabled"), "RULE_DISABLED").when(~S.at_least(F.lit(schema), F.col("min_schema")), "RULE_SKIPPED_SCHEMA").when(~active, "RULE_SKIPPED_ADAPTER").when(~known, "NO_EVALUATOR").otherwise("OK")
    return rules.withColumn("status", status)


def evaluate(spark: SparkSession, pack: list[Rule], evaluators: dict[str, Callable[[list[Rule]], DataFrame | None]], schema: str = "3.1", adapters: tuple[str, ...] = ()) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(findings, [(rule id, status)] in id order). An evaluator takes all rules that name it or share it, and gives findings; those
    of other ids are dropped, each takes the pack's severity, and of a repeated finding_id the last rule's row stays."""
    ordered = sorted(pack, key=lambda r: r.id)
    table = _literal(spark, [(i, r.enabled, r.min_schema, r.adapter or None, r.evaluator) for i, r in enumerate(ordered)], "nth int, enabled boolean, min_schema string, adapter string, evaluator string")
    status = {r["nth"]: r["status"] for r in gate_status(table, schema, list(adapters), list(evaluators)).collect()}
    telemetry = [(r.id, status[i]) for i, r in enumerate(ordered)]
    active = [(i, r) for i, r in enumerate(ordered) if status[i] == "OK"]
    out = None
    for fn in dict.fromkeys(evaluators[r.evaluator] for _, r in active):
        mine = [(i, r) for i, r in active if evaluators[r.evaluator] is fn]
        if (rows := fn([r for _, r in mine])) is None:
            continue
        of = F.create_map(*(x for i, r in mine for x in (F.lit(r.id), F.struct(F.lit(r.severity).alias("severity"), F.lit(i).alias("seq")))))[F.col("rule_id")]
        rows = rows.withColumn("_of", of).where("_of is not null").withColumns({"severity": F.col("_of.severity"), "_seq": F.col("_of.seq")}).drop("_of")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return None, telemetry
    rest = [c for c in out.columns if c not in ("finding_id", "_seq")]
    return out.groupBy("finding_id").agg(F.max_by(F.struct(*rest), "_seq").alias("r")).select("finding_id", "r.*"), telemetry
