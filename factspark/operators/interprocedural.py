"""What a program's calls say of flows between files: resolution to blocks, branches, merges, and one strength for all such flows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flows, structure

#: Callees and blocks that a name may have, functions and blocks that are kept at most.
NAME, FUNCTIONS, BLOCKS = 80, 20_000, 250_000


@dataclass
class Program:
    """calls (caller, callee, file, line, resolution), functions (name, file, line), blocks (block, name, file, line), branches
    (src, dst, rel), merges (block, preds) and totals (one row: functions, unresolved, unknown_branches, phis, strength)."""

    calls: DataFrame
    functions: DataFrame
    blocks: DataFrame
    branches: DataFrame
    merges: DataFrame
    totals: DataFrame


def blocks_of(functions: DataFrame, most: int = BLOCKS) -> DataFrame:
    """A block per function (name, file, line), the first `most` in order of file, line and name."""
    first = functions.orderBy("file", "line", "name").limit(most)
    return first.select(F.concat_ws(":", F.lit("bb"), "file", "name", F.col("line").cast("string")).alias("block"), "name", "file", "line")


def branches_of(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, dst, rel) of calls between blocks of their file: of functions with one name the last, and a block at line 0 for a name
    without any. Resolved calls go on (NEXT), others may (UNKNOWN_BRANCH)."""
    last = blocks.groupBy("file", "name").agg(F.max_by("block", "line").alias("block"))
    end = lambda name: last.select("file", F.col("name").alias(name), F.col("block").alias(f"{name}_block"))
    block = lambda name: F.coalesce(f"{name}_block", F.concat_ws(":", F.lit("bb"), "file", name, F.lit("0")))
    rows = calls.join(end("caller"), ["file", "caller"], "left").join(end("callee"), ["file", "callee"], "left")
    return rows.select(block("caller").alias("src"), block("callee").alias("dst"), F.when(F.col("resolution") == "STATIC", "NEXT").otherwise("UNKNOWN_BRANCH").alias("rel"))


def merges_of(branches: DataFrame, blocks: DataFrame) -> DataFrame:
    """Known blocks that more than one other leads to, with these in order. A block's callers are in its own file, so the list is
    no longer than a file's functions."""
    preds = F.array_sort(F.collect_set("src"))
    found = branches.groupBy(F.col("dst").alias("block")).agg(preds.alias("preds")).where(F.size("preds") > 1)
    return found.join(blocks.select("block").distinct(), "block", "left_semi")


def program(nodes: DataFrame, edges: DataFrame, most_blocks: int = BLOCKS) -> Program:
    """The program that a structural graph's functions and calls make."""
    functions = nodes.where(F.col("label").isin("Function", "Method")).select(F.substring("name", 1, NAME).alias("name"), "file", F.coalesce("line", F.lit(0)).alias("line")).where("name <> ''")
    calls = structure.resolution(nodes, edges, NAME)
    blocks = blocks_of(functions, most_blocks)
    branches = branches_of(calls, blocks)
    merges = merges_of(branches, blocks)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    # each one row
    totals = calls.agg(F.count_if(F.col("resolution") == "UNKNOWN").alias("unresolved"))
    for df in (count(functions, "functions"), count(branches.where("rel = 'UNKNOWN_BRANCH'"), "unknown_branches"), count(merges, "phis")):
        totals = totals.crossJoin(F.broadcast(df))
    strength = flows.constraint_strength(F.col("unresolved"), F.col("unknown_branches"), F.col("phis"))
    return Program(calls, functions, blocks, branches, merges, totals.withColumn("strength", strength))


def graph_rows(p: Program, snapshot: str, most_functions: int = FUNCTIONS) -> tuple[DataFrame, DataFrame]:
    """Nodes (ResolutionNode, CFGBlock) and edges (HAS_SYMBOL_RESOLUTION, CALLS_RESOLVED, CALLS_UNKNOWN, NEXT, UNKNOWN_BRANCH), these
    only between nodes that are there. Resolution nodes are left out where the program has most_functions functions or more."""
    few = p.totals.select(F.col("functions") < most_functions).scalar()
    res = lambda name: F.concat_ws(":", F.lit("resnode"), F.lit(snapshot), "file", name, F.col("line").cast("string"))
    shape = lambda df, id_, label: df.select(F.col(id_).alias("id"), F.lit(label).alias("label"), "name", F.lit(None).cast("string").alias("kind"), "file", F.col("line").cast("int").alias("line"))
    kept = p.functions.where(few).withColumn("id", res("name")).dropDuplicates(["id"])
    nodes = shape(kept, "id", "ResolutionNode").unionByName(shape(p.blocks.dropDuplicates(["block"]), "block", "CFGBlock"))
    has = kept.select(F.concat_ws(":", F.lit("file"), F.lit(snapshot), "file").alias("src"), F.lit("HAS_SYMBOL_RESOLUTION").alias("rel"), F.col("id").alias("dst"))
    called = p.calls.select(res("caller").alias("src"), F.when(F.col("resolution") == "STATIC", "CALLS_RESOLVED").otherwise("CALLS_UNKNOWN").alias("rel"), res("callee").alias("dst"))
    return nodes, has.union(structure.exported(called.unionByName(p.branches), nodes).distinct())


def edges_between_files(facts: DataFrame, p: Program, cap: int = 5_000) -> DataFrame:
    """Flows between files, shaped as those of flows.flows, with via, constraint_strength and unresolved_calls: the first cap pairs
    of a source and a sink of another file whose kinds may meet. file is the source's; sink_ord goes on after all flows within
    files; prepared tells of a statement prepared in the source's file between the two lines."""
    pairs = flows.cross_file_flows(facts, cap, "id")
    line = lambda df, at, is_pair, *more: df.select(F.col(more[0]).alias("file"), F.col(at).alias("at"), F.lit(is_pair).alias("is_pair"), *(F.col(c) if is_pair else F.lit(None).alias(c) for c in pairs.columns))
    clean = facts.where(F.expr("label = 'Sanitizer' and (context = 'SQL' or kind = 'SQL_PREPARE')"))
    both = line(pairs, "sink_line", True, "source_file").unionByName(line(clean, "line", False, "file"))
    w = flows.Window.partitionBy("file").orderBy("at").rangeBetween(flows.Window.unboundedPreceding, flows.Window.currentRow)
    rows = both.withColumn("last", F.max(F.when(~F.col("is_pair"), F.col("at"))).over(w)).where("is_pair")
    totals = p.totals.select(F.struct(F.col("strength").cast("double").alias("strength"), F.col("unresolved").cast("int").alias("unresolved"))).scalar()
    return rows.select(
        "file", "src", "dst", "source_line", "sink_line", (F.lit(1 << 40) + F.col("pair")).alias("sink_ord"), "sink_kind", "source_name", "source_kind", F.lit(False).alias("sink_static"),
        F.coalesce(F.col("last") > F.col("source_line"), F.lit(False)).alias("prepared"), F.lit("interprocedural").alias("via"), totals["strength"].alias("constraint_strength"), totals["unresolved"].alias("unresolved_calls"),
    )
