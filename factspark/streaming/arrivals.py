"""Scans over files that keep arriving: contents that were lifted before aren't lifted again, and a version of the manifest goes with
every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lift import BUDGET, LANGUAGES, lift
from ..plans.scan import Options, Scan, scan
from ..sources import files as sources
from ..sources.versions import Versions

MANIFEST = ("rel_path", "size", "language", "parse_policy", "sha256", "head")


def _key() -> F.Column:
    return F.concat_ws("-", "language", "sha256")


def described(files: DataFrame, quotas: sources.Quotas = sources.Quotas(), head: int = 8_192) -> DataFrame:
    """files (rel_path, text, size) with language, parse_policy, sha256 of the text, and head, which tells the profile."""
    rows = files if "parse_policy" in files.columns else sources.classified(files, quotas)
    return rows.withColumns({"sha256": F.sha2(F.coalesce("text", F.lit("")), 256), "head": F.substring("text", 1, head)})


def arrive(state: Versions, files: DataFrame, gone: DataFrame | None = None, budget: int = BUDGET, **about: object) -> int:
    """Takes files (as `described` gives them, with text) into the state, and those of `gone` (rel_path) out of it; returns the version.

    Spans are kept by content and language under that key's name; a content is lifted once, whatever files have it and
    however often it comes. Manifest, spans and the list of lifted contents change in one version."""
    entry = state.entry()
    has = lambda t: t in entry["tables"]
    code = files.where((F.col("parse_policy") == "parse") & F.col("language").isin(*LANGUAGES)).select(_key().alias("key"), "language", "text")
    if has("lifted"):
        code = code.join(state.read("lifted", entry["version"]).select("key"), "key", "left_anti")
    new = code.dropDuplicates(["key"])
    append = {"spans": lift(new.select(F.col("key").alias("file"), "language", "text"), budget), "lifted": new.select("key")}
    rows = files.select(*MANIFEST).dropDuplicates(["rel_path"])
    if has("manifest"):
        old = state.read("manifest", entry["version"]).join(rows.select("rel_path"), "rel_path", "left_anti")
        rows = (old if gone is None else old.join(gone.select("rel_path"), "rel_path", "left_anti")).select(*MANIFEST).unionByName(rows)
    return state.commit("arrive", {"manifest": rows}, append, base=entry["version"], **about)


def spans_of(state: Versions, version: int | None = None) -> DataFrame:
    """The spans of all files of a version's manifest, under the files' own names, as a lift of them would give."""
    version = state.entry(version)["version"]
    files = state.read("manifest", version).select("rel_path", _key().alias("file"))
    rows = state.read("spans", version).join(files, "file")
    own = lambda c: F.concat(F.lit("ir:"), "rel_path", F.substr(c, F.length("file") + 4))
    return rows.withColumns({"id": own("id"), "parent": own("parent"), "file": F.col("rel_path")}).drop("rel_path")


def scan_state(state: Versions, snapshot: str, profile: str | None = "full", version: int | None = None, options: Options = Options(), root: str = "", work: str | None = None) -> Scan:
    """A scan of a version, with nothing lifted."""
    files = state.read("manifest", version).withColumnRenamed("head", "text")
    return scan(files, snapshot, profile, options=options, root=root, work=work, spans=spans_of(state, version))


def changes(state: Versions, base: int, version: int | None = None) -> DataFrame:
    """rel_path, status: added, removed, changed or unchanged between two versions."""
    return sources.manifest_diff(state.read("manifest", base), state.read("manifest", version))


def run_arrivals(stream: DataFrame, state: Versions, checkpoint: str, quotas: sources.Quotas = sources.Quotas(), name: str = "files") -> None:
    """All that has arrived on a stream of files (rel_path, text, size, mtime), in micro-batches: of one path the last by mtime counts. A
    batch that comes again after a failure is known by its number in the state's log and changes nothing."""

    def take(rows: DataFrame, batch: int) -> None:
        done = {(a.get("stream"), a.get("batch")) for a in (state.entry(v)["about"] for v in state.versions())}
        if (name, batch) in done:
            return
        rest = [c for c in rows.columns if c != "rel_path"]
        last = rows.groupBy("rel_path").agg(F.max_by(F.struct(*rest), F.struct("mtime", "text")).alias("r")).select("rel_path", "r.*")
        arrive(state, described(last, quotas), stream=name, batch=batch)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
