"""The property graph as two tables, nodes (id, label, ...) and edges (src, rel, dst, ...): construction, layers, integrity, calls, control flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Layers by node label, then by relationship.
LAYERS = {
    "L0_REPOSITORY": ("Repository", "Snapshot", "File"),
    "L1_SEMANTIC": ("IRNode", "Symbol", "Callsite", "Class", "UnknownTarget", "ResolutionNode", "Function", "Method", "HookHandler", "AjaxHandler"),
    "L2_WORDPRESS": ("HookRegistration", "Route", "AjaxAction", "CapabilityCheck", "NonceGuardApprox"),
    "L3_FEATURE_FLOW": ("CFGBlock", "SSAVariable", "PHINode", "Source", "Sanitizer", "HeuristicPattern"),
    "L4_SECURITY": ("Sink", "SecuritySignal", "VariantCluster"),
}
# Relationships of the flow layer; signals by sink kind as (prefix, signal); ways in; entities by span kind.
FLOW_RELS = ("FLOWS_TO", "TAINTS", "CAN_REACH_SINK", "PROTECTS", "ANCHORED_AT")
SIGNALS = {"OBJECT_INJECTION": ("objinj", "OBJECT_INJECTION_ENTRYPOINT"), "CODE_EXEC": ("dang", "REACHABLE_DANGEROUS_SINK_CANDIDATE"), "UPLOAD": ("upload", "UPLOAD_LIFECYCLE")}
ENTRYPOINTS = ("wp-admin/admin-ajax.php", "xmlrpc.php", "wp-cron.php", "wp-login.php")
ENTITIES = {"Class": ("class_declaration",), "Function": ("function_definition", "function_declaration"), "Method": ("method_declaration", "method_definition"), "Callsite": ("call_expression", "scoped_call_expression", "function_call_expression", "member_call_expression")}


def layer(label: Column, rel: Column | None = None) -> Column:
    out = F
    for name, labels in LAYERS.items():
        out = out.when(label.isin(*labels), name)
    return (out.when(rel.isin(*FLOW_RELS), "L3_FEATURE_FLOW") if rel is not None else out).otherwise("L1_SEMANTIC")


def with_layers(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = nodes.withColumn("layer", layer(F.col("label")))
    return n, layered_edges(n, edges)


def layered_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the layers of their ends (nodes have theirs), and their own: that of the end, else of the start, else by rel."""
    ends = nodes.select("id", "layer")
    e = edges.join(ends.select(F.col("id").alias("src"), F.col("layer").alias("layer_src")), "src", "left").join(ends.select(F.col("id").alias("dst"), F.col("layer").alias("layer_dst")), "dst", "left")
    return e.withColumn("layer", F.coalesce("layer_dst", "layer_src", layer(F.lit(""), F.col("rel"))))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for a layered graph: ok, dangling (ends of edges that are no nodes: they have no layer) and misplaced (blocks and
    variables outside the flow layer)."""
    dangling_ends = edges.agg(F.coalesce(F.sum(F.col("layer_src").isNull().cast("long") + F.col("layer_dst").isNull().cast("long")), F.lit(0)).alias("dangling"))
    misplaced = nodes.agg(F.count_if(F.col("label").isin("CFGBlock", "SSAVariable", "PHINode") & (F.col("layer") != "L3_FEATURE_FLOW")).alias("misplaced"))
    # each one row
    return dangling_ends.crossJoin(F.broadcast(misplaced)).select((F.col("dangling") + F.col("misplaced") == 0).alias("ok"), "dangling", "misplaced")


def with_ids(edges: DataFrame, seq: str | None = None) -> DataFrame:
    """Edges with their content hash as id, one of each."""
    e = edges.withColumn("id", S.edge_id(F.col("src"), F.col("rel"), F.col("dst")))
    return e.groupBy("id").agg(*(F.min_by(c, seq).alias(c) if seq and c != seq else F.min(c).alias(c) for c in edges.columns))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, rel, dst, problem: edges whose ends are not nodes."""
    ids = nodes.select("id")
    bad = [edges.join(ids, edges[end] == ids["id"], "left_anti").select("src", "rel", "dst", F.lit(f"dangling_{end}").alias("problem")) for end in ("src", "dst")]
    return bad[0].union(bad[1])


def layer_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with layers that are missing or don't follow from their ends."""
    want = with_layers(nodes.drop("layer"), edges.drop("layer", "layer_src", "layer_dst"))[1].select("src", "rel", "dst", F.col("layer").alias("want"))
    return edges.join(want, ["src", "rel", "dst"]).where("layer is null or layer_src is null or layer_dst is null or layer <> want").select("src", "rel", "dst", F.when(F.expr("layer is null or layer_src is null or layer_dst is null"), "incomplete_layers").otherwise("layer_mismatch").alias("problem"))


def neighbors(edges: DataFrame, node: str, rel: str | None = None, out: bool = True) -> DataFrame:
    e = edges.where(F.col("src" if out else "dst") == node)
    return e if rel is None else e.where(F.col("rel") == rel)


def signals(facts: DataFrame) -> DataFrame:
    """id, file, line, signal of sinks that stand for a way in."""
    pick = lambda i: F.create_map(*(F.lit(x) for kind, v in SIGNALS.items() for x in (kind, v[i])))[F.col("kind")]
    return facts.where((F.col("label") == "Sink") & F.col("kind").isin(*SIGNALS)).select(F.concat(pick(0), F.lit(":"), "id").alias("id"), "file", "line", pick(1).alias("signal"))


def entrypoints(files: DataFrame) -> DataFrame:
    """rel_path, marker of files whose path ends in one of the known ways in."""
    p, marker = F.lower("rel_path"), F
    for m in ENTRYPOINTS:
        marker = marker.when(p.endswith(m), m)
    return files.select("rel_path", marker.otherwise(None).alias("marker")).where("marker is not null")


def entities(ir_nodes: DataFrame) -> DataFrame:
    """IR nodes as Class, Function, Method or Callsite, and the callee a callsite names ("" if it can't be told)."""
    out = F
    for label, kinds in ENTITIES.items():
        out = out.when(F.col("kind").isin(*kinds), label)
    rows = ir_nodes.withColumn("entity", out.otherwise(None)).where("entity is not null")
    return rows.withColumn("callee", F.when(F.col("entity") == "Callsite", F.regexp_extract("label", r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1)))


def base_graph(files: DataFrame, ir_nodes: DataFrame, snapshot: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Repository, Snapshot, File and IRNode nodes, with the edges between them."""
    spark = files.sparkSession
    repo = F.concat(F.lit("repo:"), S.sha(F.lit(root), 16))
    one = spark.range(1)
    file_id = lambda c: F.concat(F.lit(f"file:{snapshot}:"), c)
    nodes = one.select(repo.alias("id"), F.lit("Repository").alias("label"), F.lit(root).alias("name")).union(one.select(F.lit(snapshot), F.lit("Snapshot"), F.lit(snapshot)))
    nodes = nodes.union(files.select(file_id("rel_path"), F.lit("File"), "rel_path")).union(ir_nodes.select("id", F.lit("IRNode"), F.substring("label", 1, 120)))
    edges = one.select(repo.alias("src"), F.lit("HAS_SNAPSHOT").alias("rel"), F.lit(snapshot).alias("dst"))
    edges = edges.union(files.select(F.lit(snapshot), F.lit("IN_SNAPSHOT"), file_id("rel_path"))).union(ir_nodes.select(file_id("file"), F.lit("CONTAINS_IR"), "id"))
    return nodes, edges


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (caller, callee, file, line) with resolution: STATIC where a function of that name is known, else UNKNOWN."""
    known = functions.select(F.col("name").alias("callee"), F.lit(True).alias("known")).distinct()
    return calls.join(known, "callee", "left").withColumn("resolution", F.when(F.col("known"), "STATIC").otherwise("UNKNOWN")).drop("known")


def cfg_edges(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, dst, rel) of calls between blocks; a call into no known block goes to the default block of its name."""
    b = blocks.select(F.col("file").alias("bf"), F.col("name").alias("bn"), F.col("block"))
    to = calls.join(b, (F.col("file") == F.col("bf")) & (F.col("callee") == F.col("bn")), "left")
    return to.select(F.col("caller").alias("src"), F.coalesce("block", F.concat(F.lit("block:"), "callee")).alias("dst"), F.when(F.col("block").isNull(), "UNKNOWN_BRANCH").otherwise("NEXT").alias("rel"))


def phi_nodes(edges: DataFrame, *scope: str) -> DataFrame:
    """Blocks that more than one distinct block leads to, with these in order."""
    preds = F.array_sort(F.collect_set("src"))  # of distinct blocks
    return edges.groupBy(*scope, "dst").agg(preds.alias("preds")).where(F.size("preds") > 1)
