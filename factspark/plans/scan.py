"""A scan from files to reports: classify, lift, structure, facts, flows, rules, enrichment, groups."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, facts, flows, graph, interprocedural, platform, report, rules, structure
from ..operators.lift import BUDGET, LANGUAGES, lift
from ..sources import files as sources
from ..sources import walk
from ..sources.staging import shared_folder, written

CATALOGS = {"generic": facts.GENERIC, "platform": facts.PLATFORM}


@dataclass(frozen=True)
class Options:
    """What a scan does beside its profile. interprocedural adds the program's blocks and flows between files."""

    budget: int = BUDGET
    schema: str = "3.1"
    most_cross_file: int = 5_000
    most_functions: int = interprocedural.FUNCTIONS
    most_blocks: int = interprocedural.BLOCKS
    patterns: tuple[facts.Pattern, ...] | None = None
    heuristics: tuple[tuple[str, tuple[str, ...]], ...] | None = None
    pack: list[rules.Rule] | None = None
    interprocedural: bool = False


@dataclass
class Scan:
    """The tables of a scan. integrity is one row: ok, dangling, misplaced. release() gives back what is kept of lifted spans and facts."""

    profile: rules.Profile
    files: DataFrame
    spans: DataFrame
    facts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    integrity: DataFrame
    flows: DataFrame
    program: interprocedural.Program | None
    findings: DataFrame
    enriched: DataFrame
    groups: DataFrame
    pack: list[rules.Rule]
    telemetry: list[tuple[str, str]]
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


def _has_code() -> F.Column:
    return (F.col("parse_policy") == "parse") & F.col("language").isin(*LANGUAGES)


def parseable(files: DataFrame) -> DataFrame:
    """One row, n: classified files that there is something to lift from."""
    return files.agg(F.count_if(_has_code()).alias("n"))


def quota_kept(files: DataFrame, quotas: sources.Quotas) -> DataFrame:
    """The files within the quotas on their number and their bytes; one sum tells whether there is anything to leave out. Tables
    taken whole aren't counted."""
    if quotas == sources.WHOLE:
        return files
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n <= quotas.max_files and size <= quotas.max_total_bytes:
        return files
    return sources.within_quotas(files, quotas).where("status = 'kept'").drop("n", "total", "status")


def profile_of(classified: DataFrame, profile: str | None) -> rules.Profile:
    """A profile by name; for auto the files' paths and the heads of the first few are looked at."""
    if (profile or "auto").strip().lower() != "auto":
        return rules.resolve_profile(profile)
    signals = sources.profile_signals(classified, list(rules.PLATFORM_PATHS), list(rules.PLATFORM_MARKERS))
    return rules.resolve_profile("auto", signals.agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0])


def scan(files: DataFrame, snapshot: str, profile: str | None = "full", quotas: sources.Quotas = sources.Quotas(), options: Options = Options(), root: str = "", work: str | None = None, keep: bool = True, spans: DataFrame | None = None) -> Scan:
    """files (rel_path, text, size; those of the walk also have language and parse_policy) to findings and their groups, by the
    catalogs, adapters and rule pack of a profile.

    What several steps read is written below `work` (a folder that all executors reach) and read back, or, without it, kept in
    memory and on disk as long as keep is set. Null texts are empty; files of other languages yield nothing. All steps but flows
    between files work within a file and are partitioned by it. Spans may be given, lifted before (an incremental scan)."""
    kept: list[DataFrame] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        if work is not None:
            df.write.mode("overwrite").parquet(f"{work}/{name}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")
        if keep:
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    files = quota_kept(files, quotas)
    classified = files if "parse_policy" in files.columns else sources.classified(files, quotas)
    chosen = profile_of(classified, profile)
    if spans is None:
        spans = stage(lift(classified.where(_has_code()).select(F.col("rel_path").alias("file"), "language", "text"), options.budget), "spans")

    texts = structure.collected_texts(spans)
    patterns = options.patterns if options.patterns is not None else facts.merged(*(CATALOGS[c] for c in chosen.catalogs))
    found = facts.pattern_facts(texts, patterns).unionByName(facts.include_facts(texts, structure.INCLUDE_KINDS))
    known = stage(facts.fact_nodes(facts.deduped(found), snapshot), "facts")

    base = graph.base_graph(classified, spans.where("kind is not null").withColumn("id", F.concat_ws(":", F.lit("ir"), F.lit(snapshot), "id")), snapshot, root)
    of_structure = structure.structure(spans, snapshot)
    if options.interprocedural:  # read by the program too
        of_structure = stage(of_structure[0], "structure"), stage(of_structure[1], "structure_edges")
    adapters = list(chosen.adapters)
    of_platform = platform.adapted(adapters, structure.platform_texts(spans), classified, snapshot)
    shape = lambda df: df.select("id", "label", "name", "kind", "file", "line")
    sinks = known.where("label = 'Sink'")
    heuristic = stage(platform.heuristic_nodes(texts, snapshot, options.heuristics), "heuristics")
    security = shape(known.select("id", "label", "name", "kind", "file", "line")).union(shape(platform.signal_nodes(sinks))).union(shape(heuristic))
    file_id = F.concat_ws(":", F.lit("file"), F.lit(snapshot), "file")
    has = known.select(file_id.alias("src"), F.concat(F.lit("HAS_"), F.upper("label")).alias("rel"), F.col("id").alias("dst"))
    signals = platform.signal_nodes(sinks).select(file_id.alias("src"), F.lit("HAS_SECURITY_SIGNAL").alias("rel"), F.col("id").alias("dst"))

    # what adapters found, whatever their number
    marks, mark_edges = shape(security).where("false"), has.where("false")
    for n, e in of_platform:
        marks, mark_edges = marks.union(shape(n)), mark_edges.union(e.select("src", "rel", "dst"))
    marks, mark_edges = stage(marks, "marks"), stage(mark_edges, "mark_edges")

    within = flows.flows(known)
    between, program, extra = None, None, []
    if options.interprocedural:
        program = interprocedural.program(*of_structure, options.most_blocks)
        between = stage(interprocedural.edges_between_files(known, program, options.most_cross_file), "between")
        reach = lambda rel: between.select("src", F.lit(rel).alias("rel"), "dst")
        extra = [interprocedural.graph_rows(program, snapshot, options.most_functions), (security.where("false"), reach("FLOWS_TO").union(reach("CAN_REACH_SINK")))]
    all_flows = within if between is None else within.withColumns({"via": F.lit("same_file_ordering"), "constraint_strength": F.lit(None).cast("double"), "unresolved_calls": F.lit(None).cast("int")}).unionByName(between)
    nodes, edges = structure.merged(base, of_structure, (marks, mark_edges), (security, has.union(signals).union(within.select("src", F.lit("FLOWS_TO").alias("rel"), "dst"))), *extra)
    nodes = stage(nodes.withColumn("layer", graph.layer(F.col("label"))), "nodes")
    edges = stage(graph.layered_edges(nodes, edges), "edges")
    integrity = graph.integrity(nodes, edges)

    calls = spans.where(F.col("kind").isin(*graph.ENTITIES["Callsite"])).select("file", F.col("start_line").alias("line"), F.substring("label", 1, structure.PREVIEW).alias("label"))
    gated = all_flows.where("sink_kind <> 'FILE_INCLUDE'").unionByName(rules.without_static_includes(all_flows.where("sink_kind = 'FILE_INCLUDE'"), calls))
    routes = rules.missing_guard_routes(marks, mark_edges).select(F.col("route").alias("id"))
    open_actions = marks.where("label = 'AjaxAction' and kind = 'nopriv'")

    def of_flows(which: list[rules.Rule]) -> DataFrame:
        return rules.all_flow_findings(gated, [f for f in map(rules.flow_rule, which) if f])

    def of_nodes(rows: DataFrame, rule_id: str):
        return lambda which: rules.node_findings(rows, rules.NODE_RULES[rule_id])

    def of_objects(which: list[rules.Rule]) -> DataFrame:
        return rules.idor_findings(all_flows, marks, tuple(which[0].params.get("allowed_sink_kinds", rules.IDOR_KINDS)))

    evaluators = dict.fromkeys(rules.FLOW_EVALUATORS, of_flows) | {
        "object_injection_signal": of_nodes(platform.signal_nodes(sinks).where("kind = 'OBJECT_INJECTION_ENTRYPOINT'"), "RULE-OBJINJ-001"),
        "wp_nonce_get_only": of_nodes(heuristic.where("name = 'NONCE_GET_ONLY'"), "RULE-WP-NONCE-001"),
        "ajax_nopriv_no_cap": of_nodes(rules.without_capability(open_actions, marks), "RULE-WP-AJAX-001"),
        "wp_rest_weak": of_nodes(marks.join(routes, "id", "left_semi").withColumn("line", F.lit(1)), "RULE-WP-REST-001"),
        "wp_idor_graph": of_objects,
    }
    pack = options.pack if options.pack is not None else rules.PACKS[chosen.pack]
    findings, telemetry = rules.evaluate(files.sparkSession, pack, evaluators, options.schema, tuple(adapters))
    if findings is None:
        findings = rules.all_flow_findings(gated.where("false"), [])
    findings = findings.withColumn("ajax_nopriv", F.col("rule_id") == enrich.AJAX)
    if "wordpress" in adapters:
        findings = rules.with_framework(findings, "wordpress")

    enriched = enrich.enriched(findings, chosen.id, integrity.select("ok").scalar())
    groups = report.summary_groups(enriched.withColumn("downgraded", F.col("skeptic.verdict") == "DOWNGRADE"))
    return Scan(chosen, classified, spans, known, nodes, edges, integrity, all_flows, program, findings, enriched, groups, pack, telemetry, kept)


class NothingToScan(ValueError):
    """A tree has no file of a language that is lifted."""


def scan_tree(spark: SparkSession, root: str, snapshot: str, profile: str | None = "auto", quotas: sources.Quotas = sources.Quotas(), options: Options = Options(), work: str | None = None, follow: bool = False) -> tuple[walk.Ingest, Scan]:
    """From a folder to findings: the walk with its quotas, policies, hashes and diagnostics, then a scan of what it kept. Everything
    is written below work (without it, in the shared folder). NothingToScan if no file can be lifted."""
    work = work or shared_folder(spark, "scan")
    got = walk.ingest(spark, root, quotas, follow, work)
    files = written(got.files, f"{work}/files")
    if not parseable(files).first()[0]:
        raise NothingToScan(f"no parseable PHP, JS or HTML file in {root}")
    return replace(got, files=files), scan(files, snapshot, profile, quotas, options, root, work)
