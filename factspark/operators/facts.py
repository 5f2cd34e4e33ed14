"""Security facts: pattern catalogs over texts, keyed dedupe, names and contexts, static flags, file-wide heuristics, hooks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import catalog_values
from .catalog_values import GENERIC_SANITIZERS, URL_SANITIZERS

STATIC_PATH = f"(?i){catalog_values.STATIC_PATH_MARKERS}"
STATIC_ARGUMENT = f"(?i){catalog_values.STATIC_INCLUDE_ARGUMENT}"


@dataclass(frozen=True)
class Pattern:
    """One entry of a catalog. A literal pattern is compiled once per task."""

    label: str
    pattern: str
    kind: str
    context: str = ""
    api: str = ""
    name: str = ""

    @property
    def regex(self) -> str:
        return self.pattern if self.label == "Source" else f"(?i){self.pattern}"


def catalog(entries) -> tuple[Pattern, ...]:
    """Patterns of entries (label, pattern, properties); they are evaluated in this order."""
    return tuple(Pattern(label, pattern, **properties) for label, pattern, properties in entries)


GENERIC, PLATFORM = catalog(catalog_values.GENERIC), catalog(catalog_values.PLATFORM)


def merged(*catalogs: tuple[Pattern, ...]) -> tuple[Pattern, ...]:
    """Catalogs one after the other; of entries with one label, kind and api (or pattern) the first stays."""
    seen: dict[tuple, Pattern] = {}
    for p in (p for c in catalogs for p in c):
        seen.setdefault((p.label, p.kind, p.api or p.pattern), p)
    return tuple(seen.values())


def source_name(text: Column, regex: str, given: str) -> Column:
    """The captured superglobal, else the entry's name, else that of any request."""
    if "(" not in regex.replace(r"\(", ""):
        return F.lit(given or "$_REQUEST")
    got = F.regexp_extract(text, regex, 1)
    return F.when(got != "", F.concat(F.lit("$_"), got)).otherwise(given or "$_REQUEST")


def call_name(text: Column) -> Column:
    """The first name that is called in a text."""
    return F.regexp_extract(text, r"([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1)


def sanitizer_context(name: Column) -> Column:
    return F.when(name.startswith("esc_") | (name == "wp_kses_post"), "HTML").when(name.isin(*URL_SANITIZERS), "URL").when(name.isin(*GENERIC_SANITIZERS), "GENERIC").otherwise("UNKNOWN")


def pattern_facts(texts: DataFrame, catalog: tuple[Pattern, ...]) -> DataFrame:
    """Facts (file, line, byte_off, seq, label, kind, context, api, name, static_arg, static_path_likely) of texts (file, line,
    byte_off, text): one projection over all patterns, in catalog order."""
    t = F.col("text")
    hits = []
    for i, p in enumerate(catalog):
        name = source_name(t, p.regex, p.name) if p.label == "Source" else F.lit(p.name) if p.name or p.label == "Sink" else call_name(t)
        context = sanitizer_context(name) if p.label == "Sanitizer" and not p.name and p.context in ("", "HTML") else F.lit(p.context)
        static = F.lit(p.kind == "FILE_INCLUDE") & (t.rlike(STATIC_ARGUMENT) | t.rlike(STATIC_PATH))
        likely = F.lit(p.kind in ("REMOTE_READ", "FILE_WRITE")) & t.rlike(STATIC_PATH)
        row = F.struct(F.lit(i).alias("seq"), F.lit(p.label).alias("label"), F.lit(p.kind).alias("kind"), context.alias("context"), F.lit(p.api).alias("api"), name.alias("name"), static.alias("static_arg"), likely.alias("static_path_likely"))
        hits.append(F.when(t.rlike(p.regex), row))
    found = texts.select("file", "line", "byte_off", "text", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    return found.select("file", "line", "byte_off", "text", "h.*")


def include_facts(texts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Facts, shaped as those of patterns, of texts (with span_kind) whose span is an include. Their seq is -1: they come first."""
    t = F.col("text")
    static = t.rlike(STATIC_ARGUMENT) | t.rlike(STATIC_PATH)
    rows = texts.where(F.col("span_kind").isin(*kinds))
    return rows.select("file", "line", "byte_off", "text", F.lit(-1).alias("seq"), F.lit("Sink").alias("label"), F.lit("FILE_INCLUDE").alias("kind"), F.lit("FILE").alias("context"), F.lit("").alias("api"), F.lit("").alias("name"), static.alias("static_arg"), F.lit(False).alias("static_path_likely"))


def deduped(facts: DataFrame) -> DataFrame:
    """The first fact of each file, label, line and (for sinks) kind; facts with a negative seq come before all others."""
    key = F.when(F.col("label") == "Sink", F.col("kind")).otherwise(F.col("label"))
    w = Window.partitionBy("file", "label", "line", key).orderBy(F.col("seq") >= 0, "byte_off", "text", "seq")
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fact_nodes(facts: DataFrame, snapshot: str) -> DataFrame:
    """Deduped facts as what flows take: file, line, ord, id, label, kind, context, name, static (a path fixed in the code, or likely so). ord is a fact's place in its file;
    of facts with one id (one text can be a sink of two kinds) the last gives the properties and the first the place."""
    ord_ = F.row_number().over(Window.partitionBy("file").orderBy(F.col("seq") >= 0, "line", "byte_off", "text", "seq")).cast("long")
    rows = facts.select("file", "line", F.concat_ws(":", F.lower("label"), F.lit(snapshot), "file", F.col("line").cast("string"), F.col("byte_off").cast("string")).alias("id"), "label", "kind", "context", "name", (F.col("static_arg") | F.col("static_path_likely")).alias("static"), ord_.alias("_seq"))
    return upserted(rows, "id", "_seq")


def fact_id(snapshot: str) -> Column:
    return F.concat_ws(":", "label", F.lit(snapshot), "file", F.col("line").cast("string"), F.col("byte_off").cast("string"))


def upserted(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by seq, with ord, where the key stood first."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r"), F.min(seq).alias("ord")).select(key, "r.*", "ord")


def file_heuristic(texts: DataFrame, requirements: list[str], name: str) -> DataFrame:
    """file, pattern, line = 1 for files whose texts, joined by line breaks in (line, byte_off) order, meet every requirement: one
    may be met across two texts. A requirement that names GET takes either case."""
    met = [F.col("blob").rlike(f"(?i){r}" if "GET" in r else r) for r in requirements]
    return blob(texts).where(F.forall(F.array(*met), lambda m: m)).select("file", F.lit(name).alias("pattern"), F.lit(1).alias("line"))


def heuristics(texts: DataFrame, known: tuple[tuple[str, tuple[str, ...]], ...] = catalog_values.HEURISTICS) -> DataFrame:
    """Heuristics (name, requirements) over files; without others the built-in ones."""
    first, *rest = (file_heuristic(texts, list(requirements), name) for name, requirements in known)
    for more in rest:
        first = first.union(more)
    return first


def blob(texts: DataFrame) -> DataFrame:
    """file, blob: a file's texts in (line, byte_off) order, joined by line breaks. As large as the file, whose size ingestion bounds."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "byte_off", "text"))), lambda x: x["text"])
    return texts.groupBy("file").agg(F.array_join(ordered, "\n").alias("blob"))


def hooks(texts: DataFrame, regex: str, group: int, kind: str) -> DataFrame:
    """file, line (within the text), kind, name of all matches, in order (nth)."""
    found = texts.select("file", "text", F.posexplode(F.regexp_extract_all("text", F.lit(regex), F.lit(group))).alias("nth", "name"))
    return found.select("file", F.lit(kind).alias("kind"), (F.col("nth") + 1).alias("nth"), "name")


def guards(texts: DataFrame, capability: str, nonce: str, route: str, weak: str) -> DataFrame:
    """file, route, weak_permission, guard: a capability check, else (and only else) a nonce check."""
    m = lambda r: F.max(F.col("text").rlike(r))
    g = texts.groupBy("file").agg(m(route).alias("route"), m(weak).alias("weak"), m(capability).alias("cap"), m(nonce).alias("nonce"))
    return g.select("file", "route", (F.col("route") & F.col("weak")).alias("weak_permission"), F.when(F.col("cap"), "CapabilityCheck").when(F.col("nonce"), "NonceGuardApprox").alias("guard"))
