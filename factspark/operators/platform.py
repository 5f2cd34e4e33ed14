"""The platform's hooks, actions, routes and guards as graph rows, from files' texts joined to one; a registry of such adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import facts, graph

#: What registers hooks, open actions and routes, and what guards them. All take either case.
HOOK = r"(?i)add_(action|filter)\s*\(\s*['\"]([^'\"]+)['\"]"
OPEN_ACTION = r"(?i)wp_ajax_nopriv_([a-zA-Z0-9_-]+)"
ROUTE = r"(?i)register_rest_route\s*\("
WEAK_PERMISSION = r"(?i)permission_callback\s*=>\s*['\"]__return_true['\"]|__return_true"
CAPABILITY = r"(?i)current_user_can\s*\("
NONCE = r"(?i)(check_ajax_referer|wp_verify_nonce|check_admin_referer)\s*\("


def matches(blobs: DataFrame, regex: str) -> DataFrame:
    """file, nth, line, found: each match of a pattern in blobs (file, blob) with the line it begins on, counted within the blob.

    The texts between matches and the matches themselves alternate, so lines are a running sum of their line breaks."""
    cut, found = F.split("blob", regex, -1), F.regexp_extract_all("blob", F.lit(regex), F.lit(0))
    rows = blobs.where(F.col("blob").rlike(regex)).select("file", cut.alias("cut"), F.posexplode(found).alias("nth", "found"))
    breaks = lambda c: F.regexp_count(c, F.lit("\n"))
    before = breaks(F.element_at("cut", F.col("nth") + 1))
    rows = rows.select("file", "nth", "found", before.alias("before"), breaks(F.col("found")).alias("inside"))
    w = Window.partitionBy("file").orderBy("nth")
    return rows.select("file", "nth", "found", (F.sum(F.col("before") + F.col("inside")).over(w) - F.col("inside") + 1).cast("int").alias("line"))


def wordpress(texts: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name, kind, file, line) and edges (src, rel, dst): hooks, open actions and weak routes with the guards
    they lack, and a file's capability check or, without one, its nonce check."""
    blobs = facts.blob(texts).where(F.trim("blob") != "")
    sid, at = F.lit(snapshot), F.col("line").cast("string")
    file_id = F.concat_ws(":", F.lit("file"), sid, "file")
    node = lambda id_, label, name, kind, line: F.struct(id_.alias("id"), F.lit(label).alias("label"), name.alias("name"), kind.alias("kind"), F.col("file").alias("file"), line.cast("int").alias("line"))
    edge = lambda src, rel, dst: F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    none = F.lit(None).cast("string")

    hook = matches(blobs, HOOK).withColumns({"hook": F.regexp_extract("found", HOOK, 2), "how": F.lower(F.regexp_extract("found", HOOK, 1))})
    hook_id = F.concat_ws(":", F.lit("hook"), sid, "file", "hook", at)
    hooks = hook.select(F.array(node(hook_id, "HookRegistration", F.col("hook"), F.col("how"), F.col("line"))).alias("n"), F.array(edge(file_id, "HAS_HOOK", hook_id)).alias("e"))

    action = matches(blobs, OPEN_ACTION).withColumn("action", F.regexp_extract("found", OPEN_ACTION, 1))
    action_id = F.concat_ws(":", F.lit("ajax"), sid, "file", F.concat(F.lit("wp_ajax_nopriv_"), "action"), at)
    guard_id = F.concat(F.lit("guardcheck:"), action_id)
    actions = action.select(
        F.array(node(action_id, "AjaxAction", F.col("action"), F.lit("nopriv"), F.col("line")), node(guard_id, "GuardCheck", none, F.lit("nopriv_surface"), none)).alias("n"),
        F.array(edge(file_id, "HAS_AJAX", action_id), edge(action_id, "MISSING_GUARD", guard_id)).alias("e"),
    )

    has = lambda regex: F.col("blob").rlike(regex)
    weak = has(ROUTE) & has(WEAK_PERMISSION)
    route_id = F.concat_ws(":", F.lit("route"), sid, "file")
    weak_id, cap_id, nonce_id = F.concat(F.lit("weakperm:"), route_id), F.concat_ws(":", F.lit("capv2"), sid, "file"), F.concat_ws(":", F.lit("nonce"), sid, "file")
    there = lambda *rows: F.filter(F.array(*rows), lambda r: r.isNotNull())
    whole = blobs.select(
        there(
            F.when(has(ROUTE), node(route_id, "Route", none, F.lit("unknown"), none)),
            F.when(weak, node(weak_id, "GuardCheck", none, F.lit("weak_rest_permission"), none)),
            F.when(has(CAPABILITY), node(cap_id, "CapabilityCheck", none, none, none)).when(has(NONCE), node(nonce_id, "NonceGuardApprox", none, none, none)),
        ).alias("n"),
        there(
            F.when(has(ROUTE), edge(file_id, "HAS_ROUTE", route_id)),
            F.when(weak, edge(route_id, "MISSING_GUARD", weak_id)),
            F.when(has(CAPABILITY), edge(file_id, "HAS_CAP_CHECK", cap_id)).when(has(NONCE), edge(file_id, "HAS_NONCE_GUARD", nonce_id)),
        ).alias("e"),
    )
    all_ = hooks.union(actions).union(whole)
    nodes = all_.select(F.explode("n").alias("n")).select("n.*")
    nodes = nodes.groupBy("id").agg(*(F.max(c).alias(c) for c in nodes.columns if c != "id"))
    return nodes, all_.select(F.explode("e").alias("e")).select("e.*").distinct()


def entrypoints(files: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Entrypoint nodes of files that are known ways in, and the edges from their files."""
    found = graph.entrypoints(files).withColumn("id", F.concat_ws(":", F.lit("entrypoint"), F.lit(snapshot), "rel_path"))
    nodes = found.select("id", F.lit("Entrypoint").alias("label"), F.col("marker").alias("name"), F.lit(None).cast("string").alias("kind"), F.col("rel_path").alias("file"), F.lit(None).cast("int").alias("line"))
    return nodes, found.select(F.concat_ws(":", F.lit("file"), F.lit(snapshot), "rel_path").alias("src"), F.lit("HAS_ENTRYPOINT").alias("rel"), F.col("id").alias("dst"))


#: Adapters by name: each takes (texts, files, snapshot) and gives shards of nodes and edges.
ADAPTERS: dict[str, Callable[[DataFrame, DataFrame, str], list[tuple[DataFrame, DataFrame]]]] = {
    "wordpress": lambda texts, files, snapshot: [wordpress(texts, snapshot), entrypoints(files, snapshot)],
}


def adapted(names: list[str], texts: DataFrame, files: DataFrame, snapshot: str) -> list[tuple[DataFrame, DataFrame]]:
    """Shards of the named adapters; unknown names give nothing."""
    return [shard for name in names if name in ADAPTERS for shard in ADAPTERS[name](texts, files, snapshot)]


def heuristic_nodes(texts: DataFrame, snapshot: str, known: tuple[tuple[str, tuple[str, ...]], ...] | None = None) -> DataFrame:
    """HeuristicPattern nodes of files that meet one of the heuristics, without others the built-in ones."""
    h = facts.heuristics(texts, known) if known else facts.heuristics(texts)
    return h.select(F.concat_ws(":", F.lit("pattern"), F.lit(snapshot), "file", "pattern").alias("id"), F.lit("HeuristicPattern").alias("label"), F.col("pattern").alias("name"), F.lit(None).cast("string").alias("kind"), "file", "line")


def signal_nodes(sinks: DataFrame) -> DataFrame:
    """SecuritySignal nodes of sinks."""
    s = graph.signals(sinks)
    return s.select("id", F.lit("SecuritySignal").alias("label"), F.lit(None).cast("string").alias("name"), F.col("signal").alias("kind"), "file", "line")
