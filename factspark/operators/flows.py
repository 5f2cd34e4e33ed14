"""Flows from sources to sinks: nearest source as a running maximum, sanitizers as running maxima beside it, caps, cross-file pairs.

facts: file, line, ord, id, label, kind, context, name, static.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import running_totals
from .facts import URL_SANITIZERS

#: Which sanitizers block a sink of a kind; kinds that are not named are never blocked.
BLOCKERS = {
    "sql": (("SQL",), lambda: (F.col("context") == "SQL") | (F.col("kind") == "SQL_PREPARE")),
    "html": (("HTML",), lambda: F.col("context").isin("HTML", "GENERIC")),
    "url": (("REDIRECT", "FILE_INCLUDE", "REMOTE_READ", "UPLOAD", "FILE_WRITE"), lambda: F.col("context").isin("URL", "GENERIC") | F.col("name").isin(*URL_SANITIZERS)),
    "http": (("HTTP_CLIENT",), lambda: F.col("context").isin("URL", "GENERIC")),
}
#: Pairs that are broadcast at most.
BROADCAST_PAIRS = 100_000
#: Sink kinds that a source kind may reach in another file.
CROSS_FILE = {"HTTP_SUPERGLOBAL": ("SQL", "HTML", "REDIRECT", "HTTP_CLIENT", "CODE_EXEC", "OBJECT_INJECTION")}


def _up_to_line() -> Window:
    return Window.partitionBy("file").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)


def nearest_sources(facts: DataFrame, cleaners: bool = False) -> DataFrame:
    """A row per sink that has a source at or above it in its file: the nearest one (of several on a line the first by ord);
    blocker, the last line at or above the sink of a sanitizer that fits its kind; prepared, whether a statement is prepared below
    the source and at or above the sink. With cleaners also cleaner, the first sanitizer below the source that fits the kind.

    One shuffle by file; running maxima serve all, and for cleaners running minima from the end, so work is that of the sorts."""
    w, is_ = _up_to_line(), lambda label: F.col("label") == label
    rest = Window.partitionBy("file").orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, -1)
    if cleaners:
        facts = facts.withColumns({f"next_{k}": F.min(F.when(is_("Sanitizer") & fits(), F.struct("line", "ord", "id"))).over(rest) for k, (_, fits) in BLOCKERS.items()})
    more = [f"next_{k}" for k in BLOCKERS if cleaners]
    source = F.max(F.when(is_("Source"), F.struct("line", (-F.col("ord")).alias("o"), "id", "name", "kind", *more))).over(w)
    last = {k: F.max(F.when(is_("Sanitizer") & fits(), F.col("line"))).over(w) for k, (_, fits) in BLOCKERS.items()}
    last["prepare"] = F.max(F.when(is_("Sanitizer") & BLOCKERS["sql"][1](), F.col("line"))).over(w)

    def of_kind(pick):
        out = F
        for k, (kinds, _) in BLOCKERS.items():
            out = out.when(F.col("kind").isin(*kinds), pick(k))
        return out

    rows = facts.withColumns({"s": source, **{f"last_{k}": c for k, c in last.items()}}).where(is_("Sink") & F.col("s").isNotNull())
    prepared = F.coalesce(F.col("last_prepare") > F.col("s.line"), F.lit(False))
    cleaner = [of_kind(lambda k: F.col(f"s.next_{k}.id")).alias("cleaner")] if cleaners else []
    return rows.select("file", F.col("s.id").alias("src"), F.col("id").alias("dst"), F.col("s.line").alias("source_line"), F.col("line").alias("sink_line"), F.col("ord").alias("sink_ord"), F.col("kind").alias("sink_kind"), F.col("s.name").alias("source_name"), F.col("s.kind").alias("source_kind"), F.col("static").alias("sink_static"), of_kind(lambda k: F.col(f"last_{k}")).alias("blocker"), prepared.alias("prepared"), *cleaner)


def is_blocked() -> Column:
    return F.coalesce(F.col("blocker") > F.col("source_line"), F.lit(False))


def flows(facts: DataFrame, cap: int | None = 500) -> DataFrame:
    """FLOWS_TO edges within files: unblocked sinks with their nearest source, at most cap of a file in (line, ord) order."""
    edges = nearest_sources(facts).where(~is_blocked()).drop("blocker")
    if cap is None:
        return edges
    w = Window.partitionBy("file").orderBy("sink_line", "sink_ord")
    return edges.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def protects(facts: DataFrame) -> DataFrame:
    """PROTECTS edges: the first sanitizer below the nearest source, at or above the sink, that fits the sink's kind."""
    return nearest_sources(facts, cleaners=True).where(is_blocked()).select("file", "dst", "sink_kind", F.col("cleaner").alias("src"))


def without_known(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose (src, dst) is not there yet."""
    return edges.join(known.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def unprepared(edges: DataFrame) -> DataFrame:
    """Edges without a prepared statement below their source and at or above their sink."""
    return edges.where(~F.col("prepared"))


def cross_file_flows(facts: DataFrame, cap: int = 5_000, tie: str = "ord") -> DataFrame:
    """The first cap pairs of a source and a non-static sink of another file whose kinds may meet, in the order of source (file,
    line, tie), then sink; pair is a pair's number.

    No product is made: sinks in order are numbered by what files before theirs hold, and all sources of a file have the same
    number of partners (the sinks of all other files), so a source's first pair follows from sums over files. Only the sources
    that begin below cap give pairs; partner j of a source is sink j, or j and the own file's sinks more from these on: one join
    on equal numbers with cap rows at most.
    """
    out = None
    for kind, reach in CROSS_FILE.items():
        is_source = (F.col("label") == "Source") & (F.coalesce("kind", F.lit("HTTP_SUPERGLOBAL")) == kind)
        is_sink = (F.col("label") == "Sink") & F.col("kind").isin(*reach) & ~F.coalesce("static", F.lit(False))
        files = facts.groupBy("file").agg(F.count_if(is_source).alias("sources"), F.count_if(is_sink).alias("sinks")).where("sources + sinks > 0")
        all_ = files.agg(F.coalesce(F.sum("sinks"), F.lit(0)).alias("n")).scalar()
        # a source with more than cap partners ends the list as one with cap does
        files = files.withColumn("partners", F.least(all_ - F.col("sinks"), F.lit(cap)))
        files = running_totals(files, "file", {"sinks_to": F.col("sinks"), "pairs_to": F.col("sources") * F.col("partners")})
        files = files.select("file", "sinks", "partners", (F.col("sinks_to") - F.col("sinks")).alias("first_sink"), (F.col("pairs_to") - F.col("sources") * F.col("partners")).alias("first_pair"))
        nth = F.row_number().over(Window.partitionBy("file").orderBy("line", tie)) - 1
        s = facts.where(is_source).join(files.where((F.col("first_pair") < cap) & (F.col("partners") > 0)), "file")
        s = s.withColumn("start", F.col("first_pair") + nth * F.col("partners")).where(F.col("start") < cap)
        s = s.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("partners", cap - F.col("start")) - 1)))
        number = F.when(F.col("j") < F.col("first_sink"), F.col("j")).otherwise(F.col("j") + F.col("sinks"))
        s = s.select(F.col("file").alias("source_file"), F.col("line").alias("source_line"), F.col("ord").alias("source_ord"), F.col("id").alias("src"), F.lit(kind).alias("source_kind"), F.col("name").alias("source_name"), number.alias("number"), (F.col("start") + F.col("j")).alias("pair"))
        k = facts.where(is_sink).join(files, "file").withColumn("number", F.col("first_sink") + nth)
        k = k.select("number", F.col("file").alias("sink_file"), F.col("line").alias("sink_line"), F.col("ord").alias("sink_ord"), F.col("id").alias("dst"), F.col("kind").alias("sink_kind"))
        got = k.join(F.broadcast(s) if cap <= BROADCAST_PAIRS else s, "number").drop("number")
        out = got if out is None else out.union(got)
    if len(CROSS_FILE) > 1:  # kinds of sources take turns in the order
        order = F.row_number().over(Window.orderBy("source_file", "source_line", "src" if tie == "id" else "source_ord", "pair")) - 1
        out = out.withColumn("pair", order.cast("long")).where(F.col("pair") < cap)
    return out.orderBy("pair")


def constraint_strength(unresolved: Column, unknown_branches: Column, phis: Column) -> Column:
    return F.greatest(F.lit(0), 100 - (F.when(unresolved > 0, 30).otherwise(0) + unknown_branches + F.floor(phis / 2))).cast("int")


def lexical_flows(texts: DataFrame, source: str, sink: str, cleaner: str) -> DataFrame:
    """file, source_line, sink_line of all pairs of a source and a sink line at or below it with no cleaner from one to the other.

    A cleaner's line cuts a file into stretches (it belongs to none), so pairs are those within one stretch: an equal-key join.
    """
    clean = F.col("text").rlike(cleaner)
    part = F.sum(clean.cast("int")).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = texts.withColumns({"part": part, "clean": clean}).where("not clean")
    s = rows.where(F.col("text").rlike(source)).select("file", "part", F.col("line").alias("source_line"))
    k = rows.where(F.col("text").rlike(sink)).select("file", "part", F.col("line").alias("sink_line"))
    return s.join(k, ["file", "part"]).where("source_line <= sink_line").select("file", "source_line", "sink_line")
