"""Rule packs, catalogs and settings from YAML: includes, merges, precedence. All small: what a person writes by hand."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from ..operators.facts import Pattern
from ..operators.rules import Rule

MAX_DEPTH = 4
#: What fields of a rule are called in a pack.
RULE_FIELDS = {"severity_band": "severity", "python_evaluator_id": "evaluator", "min_graph_schema_version": "min_schema", "requires_adapter": "adapter", "evaluator_params": "params", "owasp_ids": "owasp", "cwe_ids": "cwe"}
_SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def _yaml(path: Path) -> dict:
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def rule_of(entry: dict) -> Rule:
    """A pack's entry, by either names of its fields. ValueError for an unknown severity or a missing field."""
    known = {f.name for f in fields(Rule)}
    values = {RULE_FIELDS.get(k, k): v for k, v in entry.items()}
    values = {k: v for k, v in values.items() if k in known}
    values["adapter"] = values.get("adapter") or None
    if missing := {"id", "severity", "evaluator"} - values.keys():
        raise ValueError(f"a rule has no {', '.join(sorted(missing))}: {entry}")
    if values["severity"] not in _SEVERITIES:
        raise ValueError(f"no severity: {values['severity']}")
    return Rule(**values)


def load_pack(path: str | Path) -> list[Rule]:
    """The rules of a pack: what it includes, in order, then its own; of rules with one id the first read stays. With includes they
    stand in id order, else as written. ValueError if a pack is met twice (a cycle), or for includes more than MAX_DEPTH deep."""
    seen: set[Path] = set()

    def read(p: Path, deep: int) -> list[Rule]:
        p = p.resolve()
        if deep > MAX_DEPTH:
            raise ValueError(f"includes go deeper than {MAX_DEPTH} at {p}")
        if p in seen:
            raise ValueError(f"{p} is included twice")
        seen.add(p)
        raw = _yaml(p)
        own = [rule_of(r) for r in raw.get("rules") or []]
        if not raw.get("includes"):
            return own
        found: dict[str, Rule] = {}
        for r in [r for more in raw["includes"] for r in read(p.parent / more, deep + 1)] + own:
            found.setdefault(r.id, r)
        return [found[k] for k in sorted(found)]

    return read(Path(path), 0)


@dataclass(frozen=True)
class Catalog:
    id: str
    version: str
    languages: tuple[str, ...]
    patterns: tuple[Pattern, ...]
    heuristics: tuple[tuple[str, tuple[str, ...]], ...]


def load_catalog(path: str | Path) -> Catalog:
    """A catalog's patterns (a label, a pattern, properties: directly or in a map `props`; a missing kind is the label) and heuristics
    (a name and requirements)."""
    raw, known = _yaml(Path(path)), {f.name for f in fields(Pattern)}

    def pattern(p: dict) -> Pattern:
        values = {k: str(v) for k, v in (p | (p.get("props") or {})).items() if k in known}
        return Pattern(**({"kind": values["label"]} | values))

    heuristics = tuple((h["name"], tuple(h["requirements"])) for h in raw.get("heuristic_patterns") or [])
    return Catalog(raw.get("catalog_id", Path(path).stem), str(raw.get("version", "1")), tuple(raw.get("languages") or ("php",)), tuple(map(pattern, raw.get("patterns") or [])), heuristics)


def merged_catalog(*catalogs: Catalog) -> Catalog:
    """Catalogs one after the other: of entries with one label, kind and api (or pattern) and of heuristics with one name the first
    stays."""
    from ..operators.facts import merged

    heuristics: dict[str, tuple[str, ...]] = {}
    for name, needs in (h for c in catalogs for h in c.heuristics):
        heuristics.setdefault(name, needs)
    languages = tuple(dict.fromkeys(x for c in catalogs for x in c.languages)) or ("php",)
    return Catalog("|".join(c.id for c in catalogs), ".".join(c.version for c in catalogs), languages, merged(*(c.patterns for c in catalogs)), tuple(heuristics.items()))


def content_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=vars).encode()).hexdigest()[:16]


def settings(*layers: dict) -> dict:
    """Layers from the weakest to the strongest: defaults, file, environment, arguments. Maps merge, other values replace."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_settings(*paths: str | Path, prefix: str = "FACTSPARK_", environment: Mapping[str, str] = os.environ, **arguments: object) -> dict:
    """Settings of YAML files, later ones over earlier ones (a missing file has none), then of the environment (PREFIX_A__B=x sets b in
    a map a; numbers and truth values as YAML reads them), then of arguments."""
    import yaml

    layers = [_yaml(Path(p)) for p in paths if Path(p).exists()]
    for name, text in sorted(environment.items()):
        if name.startswith(prefix):
            value: object = yaml.safe_load(text)
            for part in reversed(name[len(prefix) :].lower().split("__")):
                value = {part: value}
            layers.append(value)
    return settings(*layers, {k: v for k, v in arguments.items() if v is not None})


def scan_options(values: dict) -> tuple[dict, dict]:
    """(quotas, options) that settings ask for, as arguments of Quotas and of a scan's Options; what isn't set keeps its default."""
    pick = lambda part, names: {to: values[part][name] for name, to in names.items() if name in (values.get(part) or {})}
    quotas = pick("ingest", {"max_files": "max_files", "max_total_bytes": "max_total_bytes", "max_single_file_bytes": "max_file_bytes", "max_depth": "max_depth"})
    options = pick("parse", {"max_ir_nodes_per_file": "budget"}) | pick("graph", {"schema_version": "schema"}) | pick("taint", {"max_interprocedural_flow_edges": "most_cross_file"})
    options |= pick("semantic", {"max_functions": "most_functions", "max_cfg_blocks": "most_blocks", "taint_path_sensitive_enabled": "interprocedural"})
    if pack := (values.get("analysis") or {}).get("rule_pack_path"):
        options["pack"] = load_pack(pack)
    return quotas, options
