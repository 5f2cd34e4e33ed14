"""Reports over findings and scans: groups, roll-ups, pages, counts, ranks, shares, excerpts, job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .enrich import BUCKETS

BUCKET_NAMES = (*(b for b, _ in BUCKETS), "VERY_LOW")


def summary_groups(findings: DataFrame) -> DataFrame:
    """Findings by rule, file and sink line. findings: finding_id, rule_id, severity, file, sink_line, source_line, score, bucket,
    downgraded, blocked."""
    ids = F.array_sort(F.collect_list("finding_id"))
    lines = F.slice(F.array_sort(F.collect_set(F.coalesce("source_line", "sink_line"))), 1, 5)
    counts = [F.count_if(F.col("bucket") == b).alias(f"n_{b.lower()}") for b in BUCKET_NAMES]
    return findings.groupBy("rule_id", "file", "sink_line").agg(
        F.count("*").alias("n"), ids.alias("finding_ids"), F.max("score").alias("max_conf"), F.min("score").alias("min_conf"), *counts,
        lines.alias("sample_source_lines"), F.min_by("severity", "finding_id").alias("severity"), F.count_if("downgraded").alias("downgraded"), F.count_if("blocked").alias("blocked"),
    )


def in_report_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("max_conf"), F.desc("n"), "rule_id", "file", "sink_line")


def passes_triage(least_conf: float, least_bucket: str, with_blocked: bool) -> Column:
    """Whether a group is shown: sure enough, not blocked as a whole, and with a bucket at or above the least one (which doesn't
    count from LOW down)."""
    rank = BUCKET_NAMES.index(least_bucket)
    at_or_above = F.lit(False)
    for b in BUCKET_NAMES[: rank + 1]:
        at_or_above |= F.col(f"n_{b.lower()}") > 0
    sure = (F.col("max_conf") >= least_conf) & (F.lit(with_blocked) | (F.col("blocked") < F.col("n")))
    return sure & (at_or_above | F.lit(rank >= BUCKET_NAMES.index("LOW")))


def shown(groups: DataFrame, least_conf: float = 0.0, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Groups of rules that aren't excluded, and that are sure enough."""
    return groups.where((F.col("max_conf") >= least_conf) & ~F.col("rule_id").isin(*excluded)) if excluded else groups.where(F.col("max_conf") >= least_conf)


def owasp_rollup(findings: DataFrame, rules: DataFrame, most: int = 50) -> DataFrame:
    """owasp_id, n, finding_ids (the first by id). Findings of rules without ids are UNTAGGED."""
    tags = F.when(F.size("owasp") > 0, F.col("owasp")).otherwise(F.array(F.lit("UNTAGGED")))
    rows = findings.join(F.broadcast(rules.select("rule_id", "owasp")), "rule_id", "left").select("finding_id", F.explode(F.coalesce(tags, F.array(F.lit("UNTAGGED")))).alias("owasp_id"))
    w = Window.partitionBy("owasp_id").orderBy("finding_id")
    first = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy("owasp_id").agg(F.array_sort(F.collect_list("finding_id")).alias("finding_ids"))
    return rows.groupBy("owasp_id").agg(F.count("*").alias("n")).join(first, "owasp_id")


def filtered(findings: DataFrame, severity: str | None = None, rule: str | None = None, kind: str | None = None) -> DataFrame:
    """Findings of a severity, a rule and a type, each if given; severities and types in either case."""
    rows = findings
    if severity:
        rows = rows.where(F.col("severity") == severity.upper())
    if rule:
        rows = rows.where(F.col("rule_id") == rule)
    if kind:
        rows = rows.where(F.col("rule_id").startswith(f"RULE-{kind.upper()}-"))
    return rows


def findings_page(findings: DataFrame, severity: str | None = None, rule: str | None = None, kind: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    rows = filtered(findings, severity, rule, kind)
    return rows.orderBy("severity", "rule_id", "finding_id").offset(offset).limit(limit)


def tallied_page(findings: DataFrame, severity: str | None = None, rule: str | None = None, kind: str | None = None, offset: int = 0, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(page, tallies): a page of filtered findings, and rows (of, name, n) with the number of filtered findings (of = total) and the
    counts of all findings by severity, rule and type, so that charts show the whole scan whatever is filtered."""
    n = filtered(findings, severity, rule, kind).agg(F.count("*").alias("n")).select(F.lit("total").alias("of"), F.lit("").alias("name"), "n")
    keys = F.array(*(F.struct(F.lit(of).alias("of"), c.alias("name")) for of, c in (("severity", F.col("severity")), ("rule", F.col("rule_id")), ("type", S.vuln_type(F.col("rule_id"))))))
    all_ = findings.select(F.inline(keys)).groupBy("of", "name").agg(F.count("*").alias("n"))
    return findings_page(findings, severity, rule, kind, offset, limit), n.union(all_)


def largest_first(counts: DataFrame) -> DataFrame:
    """counts (name, n) in falling order, names breaking ties."""
    return counts.orderBy(F.desc("n"), "name")


def search(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with the text in one of the columns, in either case; nulls hold nothing. All rows for an empty text."""
    needle = text.strip().lower()
    if not needle:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle)), F.lit(False))
    return rows.where(hit)


def observed(rows: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation whose `get` gives the metrics (aggregates) once an action has read all of rows: counters without a
    second pass."""
    seen = Observation()
    return rows.observe(seen, *(c.alias(k) for k, c in metrics.items())), seen


def counts_by(findings: DataFrame, key: Column, name: str) -> DataFrame:
    return findings.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def dashboard_stats(scans: DataFrame, findings: DataFrame, latest: int = 500) -> DataFrame:
    """severity, n over the findings of the latest scans, with the number of all scans."""
    recent = scans.orderBy(F.desc("started_at"), "scan_id").limit(latest).select("scan_id")
    total = scans.agg(F.count("*").alias("total_scans"))
    return findings.join(recent, "scan_id", "left_semi").groupBy("severity").agg(F.count("*").alias("n")).join(F.broadcast(total))


def list_scans(scans: DataFrame, search: str | None = None, columns: tuple[str, ...] = (), offset: int = 0, limit: int = 50) -> DataFrame:
    if search:
        hit = F.lit(False)
        for c in columns:
            hit |= F.contains(F.lower(F.col(c)), F.lit(search.lower()))
        scans = scans.where(hit)
    return scans.orderBy(F.desc("started_at"), "scan_id").offset(offset).limit(limit)


def ranked(findings: DataFrame, most: int = 500) -> DataFrame:
    """The first findings by severity rank, rule, file and id, with truncated: whether there are more."""
    n = findings.agg((F.count("*") > most).alias("truncated"))
    return findings.withColumn("rank", S.severity_rank(F.col("severity"))).orderBy("rank", "rule_id", "file", "finding_id").limit(most).join(F.broadcast(n))


def with_share(counts: DataFrame) -> DataFrame:
    """counts (name, n) with share, in per cent of all. The counts are few; their total is one row."""
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).withColumn("share", F.round(100.0 * F.col("n") / F.col("_t"), 2)).drop("_t")


def folded(counts: DataFrame, k: int, other: str = "Other") -> DataFrame:
    """The k - 1 largest counts and the rest as one."""
    top = counts.orderBy(F.desc("n"), "name").limit(k - 1).select(F.col("name").alias("_name"))
    return counts.join(F.broadcast(top), F.col("name") == F.col("_name"), "left").groupBy(F.coalesce("_name", F.lit(other)).alias("name")).agg(F.sum("n").alias("n"))


def excerpts(anchors: DataFrame, lines: DataFrame, before: int = 1, after: int = 3, most: int = 4000) -> DataFrame:
    """anchors (id, file, line) with the lines around them. Each anchor names its few lines, so the join is on equal keys."""
    want = anchors.select("id", "file", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - before), F.col("line") + after)).alias("line"))
    found = want.join(lines.select("file", "line", "text"), ["file", "line"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return found.groupBy("id").agg(F.substring(F.array_join(ordered, "\n"), 1, most).alias("excerpt"))


def reconciled(scans: DataFrame, now: Column, stale_hours: int = 2, running: tuple[str, ...] = ("RUNNING", "QUEUED")) -> DataFrame:
    """Scans with state: those that have run for longer than stale_hours have FAILED."""
    late = F.col("status").isin(*running) & (F.col("started_at") < now - F.make_interval(hours=F.lit(stale_hours)))
    return scans.withColumn("state", F.when(late, "FAILED").otherwise(F.col("status")))


#: States of a scan that still goes on, all states that memory may tell, and what is said of them.
GOING, STATES = ("QUEUED", "RUNNING"), ("QUEUED", "RUNNING", "COMPLETED", "FAILED")
TIMED_OUT, TIMED_OUT_STEP = "Scan timed out — delete and try again", "Timed out"
QUEUED_STEP, STARTING_STEP, ANALYZING_STEP = ("Queued — position ", " (waiting for current scan to finish)"), "Starting scan worker…", "Analyzing plugin…"


def job_states(recorded: DataFrame, memory: DataFrame, log: DataFrame, artifacts: DataFrame, queue: DataFrame, now: Column, stale_hours: int = 2) -> DataFrame:
    """A row per scan that is recorded or in memory: scan_id, slug, status, stage, progress, progress_pct, findings, error, output_dir.

    recorded (scan_id, slug, status, started_at, findings, error, output_dir) is what the database holds; memory (scan_id, slug,
    status, progress, findings, error, output_dir) what workers say; log (scan_id, at, status, stage, detail, progress_pct,
    error) what scans wrote about themselves, of which the last row counts; artifacts (scan_id, output_dir, findings: of the report, null without
    one) what lies in output folders; queue (scan_id, position) who waits. Memory overrules a record that still goes on, the
    log overrules both where there is a folder, a report ends a scan that goes on, and one that has gone on for stale_hours
    has failed. Each input is reduced to a row per scan, so all are joined on equal keys.
    """
    text = lambda c: F.when(F.col(c) != "", F.col(c))  # noqa: E731  empty texts say nothing
    last = log.groupBy("scan_id").agg(F.max_by(F.struct("status", "stage", "detail", "progress_pct", "error"), "at").alias("l"))
    side = lambda df, tag: df.select("scan_id", F.struct(*[c for c in df.columns if c != "scan_id"], F.lit(True).alias("there")).alias(tag))
    rows = side(recorded, "r").join(side(memory, "m"), "scan_id", "full_outer").join(side(artifacts, "a"), "scan_id", "left").join(last, "scan_id", "left").join(queue.select("scan_id", "position"), "scan_id", "left")
    there, folder = F.col("r.there").isNotNull(), F.col("a.there").isNotNull()
    going = lambda c: F.coalesce(F.col(c).isin(*GOING), F.lit(False))
    # the record, or without one the memory; then what memory adds
    rows = rows.withColumns({
        "status": F.when(there, F.col("r.status")).otherwise(F.coalesce("m.status", F.lit("UNKNOWN"))),
        "slug": F.coalesce(text("r.slug"), text("m.slug"), F.lit("")),
        "findings": F.greatest(F.coalesce("r.findings", F.lit(0)), F.coalesce("m.findings", F.lit(0))),
        "error": F.when(there, F.col("r.error")).otherwise(F.col("m.error")),
        "output_dir": F.coalesce(text("m.output_dir"), F.col("r.output_dir")),
        "progress": text("m.progress"),
    })
    rows = rows.withColumn("status", F.when(going("status") & F.col("m.status").isin(*STATES), F.col("m.status")).otherwise(F.col("status")))
    # the log and the report, where there is a folder
    said = lambda c, *more: F.coalesce(*(F.when(folder, text(f"l.{x}")) for x in (c, *more)))
    rows = rows.withColumns({
        "status": F.coalesce(said("status"), "status"), "progress": F.coalesce(said("detail", "stage"), "progress"), "stage": said("stage"),
        "progress_pct": F.when(folder, F.expr("try_cast(l.progress_pct AS double)")), "error": F.coalesce(said("error"), "error"),
        "output_dir": F.coalesce("a.output_dir", "output_dir"), "findings": F.greatest("findings", F.coalesce("a.findings", F.lit(0))),
    })
    rows = rows.withColumn("status", F.when(going("status") & F.col("a.findings").isNotNull(), "COMPLETED").otherwise(F.col("status")))
    late = going("status") & F.coalesce(F.col("r.started_at") < now - F.make_interval(hours=F.lit(stale_hours)), F.lit(False))
    rows = rows.withColumns({"error": F.when(late, F.coalesce(text("error"), F.lit(TIMED_OUT))).otherwise(F.col("error")), "progress": F.when(late, TIMED_OUT_STEP).otherwise(F.col("progress")), "status": F.when(late, "FAILED").otherwise(F.col("status"))})
    # who waits, and what is said of those that go on
    going_on, waits, starts = going("status"), F.col("position") > 0, (F.col("position") == 0) & F.col("progress").isNull()
    waits, starts = F.coalesce(waits, F.lit(False)), F.coalesce(starts, F.lit(False))
    progress = F.when(waits, F.concat(F.lit(QUEUED_STEP[0]), F.col("position").cast("string"), F.lit(QUEUED_STEP[1]))).when(starts, STARTING_STEP).otherwise(F.coalesce("progress", F.lit(ANALYZING_STEP)))
    stage = F.when(waits, "queued").when(starts, F.coalesce("stage", F.lit("starting"))).otherwise(F.col("stage"))
    pct = F.coalesce("progress_pct", F.when(starts, 1.0).otherwise(0.0))
    pick = lambda new, old: F.when(going_on, new).otherwise(F.col(old))
    return rows.select("scan_id", "slug", pick(F.when(waits, "QUEUED").otherwise(F.col("status")), "status").alias("status"), pick(stage, "stage").alias("stage"), pick(progress, "progress").alias("progress"), pick(pct, "progress_pct").alias("progress_pct"), "findings", "error", "output_dir")


def markdown(groups: DataFrame) -> DataFrame:
    """section: a summary group as a heading and a list, secrets taken out."""
    text = F.concat(F.lit("## "), "rule_id", F.lit(" — `"), "file", F.lit("` L"), F.col("sink_line").cast("string"), F.lit("\n- instances: **"), F.col("n").cast("string"), F.lit("**\n- severity: **"), "severity", F.lit("**\n- confidence: max **"), F.format_number("max_conf", 3), F.lit("**, min **"), F.format_number("min_conf", 3), F.lit("**\n"))
    return groups.select("rule_id", "file", "sink_line", S.redact(text).alias("section"))
