"""Enrichment of findings, row by row: hypothesis, skeptic, verification, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base, weights in the order they are summed, overrides by profile, buckets; below them check ids, verdicts and reasons.
BASE = 0.45
WEIGHTS = {
    "witness_shortest_len": -0.002,
    "semantic_trace_len": 0.01,
    "constraint_strength": 0.25,
    "sanitizer_on_all_paths": 0.15,
    "dynamic_call_unresolved_on_path": -0.1,
    "analysis_limits_present": -0.2,
    "graph_derived_witness": 0.08,
    "missing_guard_signal": -0.05,
    "ajax_nopriv_true": -0.12,
    "skeptic_block_promotion": -0.4,
    "static_verifier_refuted": -0.5,
    "graph_integrity_ok": 0.05,
    "approximate_flow": -0.25,
    "lift_derived_flow": -0.15,
    "graph_integrity_failed": -0.1,
}
PROFILES = {"generic-php": {"ajax_nopriv_true": 0.0, "analysis_limits_present": -0.15}, "wordpress": {}}
BUCKETS = (("VERY_HIGH", 0.85), ("HIGH", 0.65), ("MEDIUM", 0.45), ("LOW", 0.25))
AJAX, PROMOTABLE = "RULE-WP-AJAX-001", ("RULE-SQLI-001", "RULE-XSS-001")

_w = lambda name: F.col(f"witness.{name}")


def _summary(findings: DataFrame, name: str, kind: str) -> Column:
    """A field of the constraint summary, null where its rule has none."""
    fields = findings.schema["witness"].dataType["constraint_summary"].dataType.names
    return F.col(f"witness.constraint_summary.{name}").cast(kind) if name in fields else F.lit(None).cast(kind)


def hypothesis(rule_id: Column, lines: Column) -> Column:
    """(text, hash) of the deterministic summary."""
    body = F.concat(F.lit("Deterministic summary for "), rule_id, F.lit("; anchors at lines ["), F.array_join(lines, ", "), F.lit("]."))
    return F.struct(body.alias("text"), F.substring(F.sha2(body, 256), 1, 12).alias("hash"))


def with_skeptic(findings: DataFrame) -> DataFrame:
    """verdict, reason, blocked: the first case that holds."""
    approx = F.coalesce(_summary(findings, "approximate_flow", "boolean"), F.lit(False))
    limits = _w("analysis_limits")
    promotable = F.col("rule_id").isin(*PROMOTABLE)
    open_ = promotable & F.array_contains(limits, "coarse_taint_approximation") & (F.coalesce(_summary(findings, "unresolved_calls", "int"), F.lit(0)) > 0)
    cases = [
        (approx, "DOWNGRADE", "SAME_FILE_ORDERING_APPROX"),
        (F.array_contains(limits, "interprocedural_heuristic"), "DOWNGRADE", "INTERPROCEDURAL_HEURISTIC"),
        (open_, "BLOCK_PROMOTION", "INTERPROCEDURAL_UNRESOLVED"),
        (promotable & F.col("title_key").endswith(".graph_flow"), "ALLOW_PROMOTION", "GRAPH_DERIVED_FLOW"),
        (promotable, "DOWNGRADE", "LEGACY_COARSE_TEMPLATE"),
    ]
    out = F
    for when, verdict, reason in cases:
        out = out.when(when, F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason")))
    out = out.otherwise(F.struct(F.lit("ALLOW_PROMOTION").alias("verdict"), F.lit("").alias("reason")))
    return findings.withColumn("skeptic", out).withColumn("blocked", F.col("skeptic.verdict") == "BLOCK_PROMOTION")


def with_verification(findings: DataFrame) -> DataFrame:
    """checks (id, passed: null is open, detail as JSON), status: REFUTED if one failed, else INCONCLUSIVE if one is open, else
    CONFIRMED; and artifact_sha256 over the checks' canonical JSON."""
    ajax = F.coalesce(F.col("ajax_nopriv"), F.lit(False)) if "ajax_nopriv" in findings.columns else F.lit(False)
    count = lambda name, n: F.concat(F.lit(f'{{"{name}": '), n.cast("string"), F.lit("}"))
    check = lambda name, passed, detail=F.lit("{}"): F.struct(F.lit(name).alias("check_id"), passed.alias("passed"), detail.alias("detail"))
    anchors = F.when(F.col("source_line").isNull(), 1).otherwise(2)
    checks = [
        check("HAS_WITNESS_PATH", (F.size(_w("path_edges")) > 0) | (F.col("rule_id") == AJAX), count("edges", F.size(_w("path_edges")))),
        check("ANCHOR_LINE_POSITIVE", (F.coalesce("source_line", "sink_line") > 0) & (F.col("sink_line") > 0), count("anchors", anchors)),
        check("SEMANTIC_TRACE_PRESENT_OR_COARSE", (F.size(_w("semantic_trace")) > 0) | F.contains("title_key", F.lit("coarse")) | F.contains("title_key", F.lit("graph")), count("semantic_trace_len", F.size(_w("semantic_trace")))),
        check("ANALYSIS_LIMITS_EXPLICIT_IF_PRESENT", F.forall(_w("analysis_limits"), lambda x: x != ""), count("analysis_limits", F.size(_w("analysis_limits")))),
        F.when(F.col("rule_id") == AJAX, check("AJAX_NOPRIV_FLAG", ajax)),
        F.when(_summary(findings, "approximate_flow", "boolean"), check("APPROX_FLOW_ACKNOWLEDGED", F.lit(None).cast("boolean"), F.lit('{"approximate": true}'))),
    ]
    rows = findings.withColumn("checks", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    failed, open_ = F.exists("checks", lambda x: F.coalesce(~x["passed"], F.lit(False))), F.exists("checks", lambda x: x["passed"].isNull())
    line = lambda x: F.concat(F.lit('{"check_id": "'), x["check_id"], F.lit('", "details": '), x["detail"], F.lit(', "passed": '), F.coalesce(x["passed"].cast("string"), F.lit("null")), F.lit("}"))
    rows = rows.withColumn("artifact_sha256", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("checks", line), ", "), F.lit("]")), 256))
    return rows.withColumn("verification", F.when(failed, "REFUTED").when(open_, "INCONCLUSIVE").otherwise("CONFIRMED"))


def with_score(findings: DataFrame, profile: str = "", integrity_ok: bool | Column = True) -> DataFrame:
    """features, score and bucket of findings that have been verified and met the skeptic."""
    whole = (F.lit(integrity_ok) if isinstance(integrity_ok, bool) else integrity_ok).cast("int").cast("double")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    trace = _w("semantic_trace")
    strength = F.coalesce(_summary(findings, "constraint_strength", "double"), F.lit(0.0))
    ajax = F.col("ajax_nopriv") if "ajax_nopriv" in findings.columns else F.lit(False)
    features = {
        "witness_shortest_len": F.size(_w("summary_hops")).cast("double"),
        "semantic_trace_len": F.size(trace).cast("double"),
        "constraint_strength": F.when(strength > 1, strength / 100).otherwise(strength),
        "sanitizer_on_all_paths": one(_summary(findings, "sql_prepare_on_path", "boolean")),
        "dynamic_call_unresolved_on_path": one(_summary(findings, "unresolved_calls", "int") > 0),
        "analysis_limits_present": one(F.size(_w("analysis_limits")) > 0),
        "graph_derived_witness": one(F.exists(trace, lambda x: x.startswith("graph:"))),
        "missing_guard_signal": one(F.exists(trace, lambda x: x.contains("MISSING_GUARD")) | F.col("rule_id").startswith("RULE-WP-REST")),
        "ajax_nopriv_true": one(ajax),
        "skeptic_block_promotion": one(F.col("blocked")),
        "static_verifier_refuted": one(F.col("verification") == "REFUTED"),
        "graph_integrity_ok": whole,
        "approximate_flow": one(_summary(findings, "approximate_flow", "boolean")),
        "lift_derived_flow": one(F.array_contains(trace, "lift_derived_flow")),
        "graph_integrity_failed": 1 - whole,
    }
    weights = WEIGHTS | PROFILES.get(profile, {})
    score = F.lit(BASE)
    for name, feature in features.items():
        score = score + F.lit(weights[name]) * feature
    rows = findings.withColumn("features", F.struct(*(c.alias(k) for k, c in features.items()))).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return rows.withColumn("bucket", bucket(F.col("score")))


def explained(findings: DataFrame, profile: str = "") -> DataFrame:
    """finding_id, feature, value, contribution: what each feature adds to a finding's score, in the order of summation (nth)."""
    weights = WEIGHTS | PROFILES.get(profile, {})
    rows = [F.struct(F.lit(i).alias("nth"), F.lit(k).alias("feature"), F.col(f"features.{k}").alias("value"), (F.lit(weights[k]) * F.col(f"features.{k}")).alias("contribution")) for i, k in enumerate(WEIGHTS)]
    return findings.select("finding_id", F.inline(F.array(*rows)))


def trace(findings: DataFrame) -> DataFrame:
    """A row of the reasoning trace per enriched finding."""
    return findings.select("finding_id", F.lit("deterministic_pipeline").alias("step"), F.col("hypothesis.hash").alias("hypothesis_hash"), F.col("verification").alias("verification_status"))


def bucket(score: Column) -> Column:
    out = F
    for name, least in BUCKETS:
        out = out.when(score >= least, name)
    return out.otherwise("VERY_LOW")


def enriched(findings: DataFrame, profile: str = "", integrity_ok: bool | Column = True) -> DataFrame:
    """Findings with hypothesis, skeptic, verification, features, score and bucket. A finding on one node has no source_line."""
    rows = findings.withColumn("hypothesis", hypothesis(F.col("rule_id"), F.array_compact(F.array(F.col("source_line").cast("string"), F.col("sink_line").cast("string")))))
    return with_score(with_verification(with_skeptic(rows)), profile, integrity_ok)


def workflow(findings: DataFrame, scan_id: str, integrity_ok: bool = True) -> tuple[DataFrame, DataFrame]:
    """(enriched, trace): the four steps in one pass with the plain weights, and a row (nth, step, scan_id, mode, n) for each step."""
    n = findings.agg(F.count("*").alias("all"))
    step = lambda nth, name, mode, count: F.struct(F.lit(nth).alias("nth"), F.lit(name).alias("step"), F.lit(scan_id).alias("scan_id"), F.lit(mode).cast("string").alias("mode"), count.cast("long").alias("n"))
    steps = F.array(
        step(0, "extract", None, F.col("all")),
        step(1, "analyst", "deterministic_template", F.lit(None)),
        step(2, "skeptic", "deterministic_rules", F.lit(None)),
        step(3, "finalize", None, F.col("all")),
    )
    return enriched(findings, integrity_ok=integrity_ok), n.select(F.inline(steps))
