"""Where results go: JSON lines, span files, a scan's report folder, keyed upserts, a scan's lineage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, *order: str) -> None:
    """Rows in order over part files (ranges of the order), nulls left out."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_document(rows: DataFrame, path: str, head: dict, field: str, *order: str) -> None:
    """One JSON document as text parts: put together in the order of their names they are an object with the head's fields and `field`,
    an array of the rows in order. No task holds it. Rows that are alike in order are left as they come."""
    begin = json.dumps(head, sort_keys=True)[:-1] + (", " if head else "") + json.dumps(field) + ": ["
    numbered = rows.withColumn("_key", F.struct(*order, F.xxhash64(F.to_json(F.struct(*rows.columns)))))
    first = numbered.agg(F.min("_key").alias("k")).scalar()
    line = F.concat(F.when(F.col("_key") == first, "").otherwise(","), F.to_json(F.struct(*rows.columns)))
    body = numbered.dropDuplicates(["_key"]).select(F.lit(1).alias("_at"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), line.alias("value"), (F.col("_key") != first).cast("int").alias("_later"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)]
    ends = [rows.sparkSession.range(1).select(F.lit(at).alias("_at"), *none, F.lit(text).alias("value"), F.lit(0).alias("_later")) for at, text in ((0, begin), (2, "]}"))]
    keys = ["_at", *(f"_o{i}" for i in range(len(order))), "_later"]
    ends[0].unionByName(body).unionByName(ends[1]).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    write_json_lines(nodes, f"{path}/nodes", "id")
    write_json_lines(edges, f"{path}/rels", "src", "rel", "dst")


def write_spans(spans: DataFrame, path: str) -> None:
    """Spans in (file, ord) order over part files of whole ranges of files: a file's spans lie together, and the number of part files
    follows the data's size, not the number of files."""
    spans.repartitionByRange("file").sortWithinPartitions("file", "ord").write.mode("overwrite").json(path)


def write_report(enriched: DataFrame, groups: DataFrame, rules: DataFrame, path: str, scan_id: str, about: dict | None = None, least_conf: float = 0.0, excluded: tuple[str, ...] = ()) -> None:
    """A scan's findings and summaries below path, each as JSON lines: findings/enriched, findings/candidates (what rules said, before
    enrichment), findings/compact (id, score, bucket and states), reports/groups in report order, reports/shown (the groups of rules that
    aren't excluded, sure enough), reports/owasp, and trace; reports/findings is one JSON document with what is known about the scan."""
    from ..operators import enrich, report

    added = {"hypothesis", "skeptic", "blocked", "checks", "artifact_sha256", "verification", "features", "score", "bucket"}
    with_scan = lambda df: df.select(F.lit(scan_id).alias("scan_id"), *df.columns)
    write_json_lines(with_scan(enriched), f"{path}/findings/enriched", "finding_id")
    write_json_lines(with_scan(enriched.drop(*added)), f"{path}/findings/candidates", "finding_id")
    write_json_lines(with_scan(enriched.select("finding_id", "score", "bucket", "verification", F.col("skeptic.verdict").alias("verdict"))), f"{path}/findings/compact", "finding_id")
    with_scan(groups).select(F.to_json(F.struct("scan_id", *groups.columns)).alias("value"), "max_conf", "n", "rule_id", "file", "sink_line").repartitionByRange(F.desc("max_conf"), F.desc("n"), "rule_id", "file", "sink_line").sortWithinPartitions(F.desc("max_conf"), F.desc("n"), "rule_id", "file", "sink_line").select("value").write.mode("overwrite").text(f"{path}/reports/groups")
    write_json_lines(report.shown(groups, least_conf, excluded), f"{path}/reports/shown", "rule_id", "file", "sink_line")
    write_document(enriched, f"{path}/reports/findings", {"scan_id": scan_id} | (about or {}), "findings", "finding_id")
    write_json_lines(with_scan(report.owasp_rollup(enriched, rules)), f"{path}/reports/owasp", "owasp_id")
    write_json_lines(with_scan(enrich.trace(enriched)), f"{path}/trace", "finding_id")


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    """rel_path, code rows as JSON lines in order."""
    write_json_lines(diagnostics, path, "rel_path", "code")


def append_status(spark: SparkSession, path: str, scan_id: str, status: str, step: str = "", at: str | None = None) -> None:
    """One more row of a scan's log; latest_status reads the log back."""
    row = spark.range(1).select(F.lit(scan_id).alias("scan_id"), F.lit(status).alias("status"), F.lit(step).alias("step"), (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias("at"))
    row.write.mode("append").json(path)


def latest_status(spark: SparkSession, path: str) -> DataFrame:
    """scan_id, status, step, at: the last row of each scan's log; of rows of one moment the one whose status and step sort last."""
    log = spark.read.schema("scan_id string, status string, step string, at timestamp").json(path)
    return log.groupBy("scan_id").agg(F.max(F.struct("at", "status", "step")).alias("r")).select("scan_id", "r.status", "r.step", "r.at")


def write_lineage(files: DataFrame, path: str, snapshot: str, base: str | None = None) -> DataFrame:
    """rel_path, status of files (rel_path, sha256) against the manifest of the base snapshot below path (without one all are added),
    written beside the new manifest. Each snapshot has its own folder, so a failed write leaves the earlier ones whole."""
    from .files import manifest_diff

    spark, manifest = files.sparkSession, files.select("rel_path", "sha256")
    known = spark.read.parquet(f"{path}/{base}/manifest") if base else manifest.where("false")
    manifest.write.mode("overwrite").parquet(f"{path}/{snapshot}/manifest")
    manifest_diff(known, spark.read.parquet(f"{path}/{snapshot}/manifest")).write.mode("overwrite").parquet(f"{path}/{snapshot}/diff")
    return spark.read.parquet(f"{path}/{snapshot}/diff")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those of equal keys, for tables without MERGE; write it to a new folder."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def without_scan(scan_id: str, *tables: DataFrame) -> list[DataFrame]:
    """Tables without the rows of a scan, as a delete that cascades leaves them."""
    return [t.where(F.col("scan_id").isNull() | (F.col("scan_id") != scan_id)) for t in tables]


def evidence(findings: DataFrame, excerpts: DataFrame) -> DataFrame:
    """A bundle per finding: its folder name, witness and excerpt."""
    return findings.join(excerpts.withColumnRenamed("id", "finding_id"), "finding_id", "left").select(F.substring(F.sha2("finding_id", 256), 1, 24).alias("folder"), "finding_id", F.to_json("witness").alias("witness"), "excerpt")
