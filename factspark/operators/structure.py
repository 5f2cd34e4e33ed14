"""What code consists of, as graph rows: classes, functions and callsites with their edges, call targets, resolution, texts.

spans are those of lift.lift; nodes are (id, label, name, kind, file, line), edges (src, rel, dst).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import graph
from .facts import upserted

#: Folders and files whose callsites are left out, and how much of a text a node carries.
VENDOR = ("**/*.min.js", "**/vendor/**", "**/node_modules/**")
PREVIEW = 120
CALL_TEXTS = ("call_expression", "scoped_call_expression")
INCLUDE_KINDS = ("include_expression", "include_once_expression", "require_expression", "require_once_expression")


def entity_rows(spans: DataFrame, snapshot: str, vendor: tuple[str, ...] = VENDOR) -> DataFrame:
    """Spans that are entities, with node (their id in the graph), ir (their span's id there) and callee. Callsites of vendored
    files are left out."""
    rows = graph.entities(spans.where("kind is not null").withColumn("preview", F.substring("label", 1, PREVIEW)).withColumn("label", F.col("preview")))
    rows = rows.where((F.col("entity") != "Callsite") | ~S.matches_glob(F.col("file"), list(vendor)))
    prefix = F.when(F.col("entity") == "Class", "class").when(F.col("entity") == "Callsite", "callsite").otherwise("func")
    last = F.when(F.col("entity") == "Callsite", F.col("start_byte").cast("string")).otherwise(F.col("kind"))
    return rows.withColumns({"node": F.concat_ws(":", prefix, F.lit(snapshot), "file", F.col("start_line").cast("string"), last), "ir": F.concat_ws(":", F.lit("ir"), F.lit(snapshot), "id")})


def structure(spans: DataFrame, snapshot: str, vendor: tuple[str, ...] = VENDOR) -> tuple[DataFrame, DataFrame]:
    """Entity, Symbol and UnknownTarget nodes; DEFINED_IN, HAS_CALLSITE, ANCHORED_AT, CONTAINS, CALLS, CALLS_TARGET and
    CALLS_UNKNOWN edges. Of entities with one id the last in (file, ord) order gives the properties.

    Parents come with the spans, so nesting is one join on equal ids; an edge needs both ends to be entities."""
    rows = entity_rows(spans, snapshot, vendor)
    call = F.col("entity") == "Callsite"
    file_id = F.concat_ws(":", F.lit("file"), F.lit(snapshot), "file")
    own = rows.select(F.col("node").alias("id"), F.col("entity").alias("label"), F.col("preview").alias("name"), "kind", "file", F.col("start_line").alias("line"), F.struct("file", "ord").alias("_seq"))
    own = upserted(own, "id", "_seq").drop("ord")
    nested = rows.where("parent is not null").join(rows.where(~call).select(F.col("id").alias("parent"), F.col("node").alias("above")), "parent")
    calls = nested.where(call)
    known = F.col("callee") != ""
    symbol, unknown = F.concat_ws(":", F.lit("sym"), F.lit(snapshot), "callee"), F.concat(F.lit("unknown:"), "node")
    symbols = calls.where(known).groupBy(symbol.alias("id"), F.col("callee").alias("name")).agg(F.max("file").alias("file"))
    nodes = (
        own.unionByName(symbols.select("id", F.lit("Symbol").alias("label"), "name", F.lit(None).cast("string").alias("kind"), "file", F.lit(None).cast("int").alias("line")))
        .unionByName(calls.where(~known).select(unknown.alias("id"), F.lit("UnknownTarget").alias("label"), F.col("node").alias("name"), F.lit(None).cast("string").alias("kind"), "file", F.col("start_line").alias("line")).dropDuplicates(["id"]))
    )
    pair = lambda src, rel, dst: F.struct(src.alias("src"), rel.alias("rel"), dst.alias("dst"))
    one = rows.select(F.explode(F.array(pair(file_id, F.when(call, "HAS_CALLSITE").otherwise("DEFINED_IN"), F.col("node")), pair(F.col("node"), F.lit("ANCHORED_AT"), F.col("ir")))).alias("e"))
    target = pair(F.col("node"), F.when(known, "CALLS_TARGET").otherwise("CALLS_UNKNOWN"), F.when(known, symbol).otherwise(unknown))
    two = nested.select(F.explode(F.when(call, F.array(pair(F.col("above"), F.lit("CALLS"), F.col("node")), target)).otherwise(F.array(pair(F.col("above"), F.lit("CONTAINS"), F.col("node"))))).alias("e"))
    return nodes, one.union(two).select("e.*").distinct()


def counts(nodes: DataFrame) -> DataFrame:
    """file, label, n: what each file holds."""
    return nodes.where(F.col("label").isin("Class", "Function", "Method", "Callsite")).groupBy("file", "label").agg(F.count("*").alias("n"))


def stats(nodes: DataFrame, spans: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: functions, methods, classes, callsites, truncated_files (that ran out of the budget of spans), sources, sinks, sanitizers."""
    of = lambda df, names, **more: df.agg(*(F.count_if(F.col("label") == v).alias(k) for k, v in names.items()), *(c.alias(k) for k, c in more.items()))
    code = of(nodes, {"functions": "Function", "methods": "Method", "classes": "Class", "callsites": "Callsite"})
    short = spans.agg(F.count_distinct(F.when(F.col("diagnostic") == "IR_BUDGET_EXCEEDED", F.col("file"))).alias("truncated_files"))
    security = of(facts, {"sources": "Source", "sinks": "Sink", "sanitizers": "Sanitizer"})
    # each one row
    return code.crossJoin(F.broadcast(short)).crossJoin(F.broadcast(security))


def resolution(nodes: DataFrame, edges: DataFrame, most: int = 80) -> DataFrame:
    """caller, callee, file, line, resolution of calls out of functions and methods: STATIC where a function goes by the name
    the callsite's symbol has, else UNKNOWN (callee "unknown" without a symbol)."""
    functions = nodes.where(F.col("label").isin("Function", "Method")).select(F.col("id").alias("src"), F.substring("name", 1, most).alias("caller"))
    names = functions.where("caller <> ''").select(F.col("caller").alias("callee")).distinct().withColumn("known", F.lit(True))
    sites = nodes.where("label = 'Callsite'").select(F.col("id").alias("dst"), "file", "line")
    targets = edges.where("rel = 'CALLS_TARGET'").join(nodes.where("label = 'Symbol'").select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst").select(F.col("src").alias("dst"), "callee")
    calls = edges.where("rel = 'CALLS'").join(functions, "src").join(sites, "dst").join(targets, "dst", "left").join(names, "callee", "left")
    return calls.select("caller", F.coalesce("callee", F.lit("unknown")).alias("callee"), "file", "line", F.when(F.col("known"), "STATIC").otherwise("UNKNOWN").alias("resolution"))


def exported(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "rel", "dst")


def merged(*shards: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several shards: of nodes with one id the last shard's stays, edges once each."""
    nodes, edges = None, None
    for i, (n, e) in enumerate(shards):
        n = n.withColumn("_shard", F.lit(i))
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
    return upserted(nodes, "id", "_shard").drop("ord"), edges.distinct()


def collected_texts(spans: DataFrame, vendor: tuple[str, ...] = VENDOR) -> DataFrame:
    """file, line, byte_off, text, span_kind that fact patterns look at: labels, their previews where these are other texts than
    those of the line so far, and previews of scoped calls (at byte 0). span_kind is that of a label, else null."""
    spans = spans.where("kind is not null")
    preview = F.substring("label", 1, PREVIEW)
    call = F.col("kind").isin(*CALL_TEXTS) & ~S.matches_glob(F.col("file"), list(vendor)) & (preview != "")
    row = lambda origin, byte, text: F.struct(F.lit(origin).alias("origin"), byte.alias("byte_off"), text.alias("text"))
    rows = [row(0, F.col("start_byte"), F.col("label")), F.when(F.length("label") > PREVIEW, row(1, F.col("start_byte"), preview)), F.when(call, row(2, F.lit(0), preview))]
    texts = spans.select("file", F.col("start_line").alias("line"), F.col("ord").alias("span_ord"), "kind", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("t")).select("file", "line", "span_ord", "kind", "t.*")
    first = F.row_number().over(Window.partitionBy("file", "line", "text").orderBy("origin", "span_ord"))
    texts = texts.withColumn("_first", first).where("origin <> 1 or _first = 1")
    return texts.select("file", "line", "byte_off", "text", F.when(F.col("origin") == 0, F.col("kind")).alias("span_kind"))


def platform_texts(spans: DataFrame, vendor: tuple[str, ...] = VENDOR) -> DataFrame:
    """file, line, byte_off (an order within the line), text of what platform patterns look at: previews of all spans, then
    scoped calls, then functions and methods. Other calls stand within their statements."""
    spans = spans.where("kind is not null").where(~F.col("kind").isin("function_call_expression", "member_call_expression"))
    preview = F.substring("label", 1, PREVIEW)
    named = F.col("kind").isin(*graph.ENTITIES["Function"], *graph.ENTITIES["Method"])
    call = F.col("kind").isin(*CALL_TEXTS) & ~S.matches_glob(F.col("file"), list(vendor))
    which: list[Column] = [F.lit(0), F.when(call, F.lit(1)), F.when(named, F.lit(2))]
    return spans.select("file", F.col("start_line").alias("line"), F.explode(F.filter(F.array(*which), lambda x: x.isNotNull())).alias("byte_off"), preview.alias("text")).where("text <> ''")
