"""Scalar expressions: paths and languages, redaction, names, versions, ids. All are built-in column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language, and what marks a bundled script.
LANGUAGES = {
    "php": (".php", ".phtml", ".inc"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"),
    "html": (".html", ".htm"),
}
BUNDLE_HINTS = ("vendor", "bundle", "chunk", "polyfill", ".min.")
BUNDLE_BYTES = 200 * 1024
# Titles by the type within a rule id.
TITLES = {
    "SQLI": "SQL Injection",
    "XSS": "Cross-Site Scripting",
    "REDIRECT": "Open Redirect",
    "LFI": "Local File Inclusion",
    "RFI": "Remote File Inclusion",
    "RCE": "Remote Code Execution",
    "UPLOAD": "Unsafe File Upload",
    "SSRF": "Server-Side Request Forgery",
    "CSV": "CSV Injection",
    "OBJINJ": "Object Injection",
    "WP": "WordPress Security",
}
# Severities in order, what is redacted, the shape of an id.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
SECRET = r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*[^\s]+"
TOKEN = r"^[A-Za-z0-9_.-]{20,255}$"
FINDING_ID = r"^FINDING\|[^|]+\|[^|]+\|[^|]+\|[0-9a-f]{16}$"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"[^.](\.[^.]+)$", 1))


def language(path: Column) -> Column:
    ext, out = extension(path), F
    for lang, exts in LANGUAGES.items():
        out = out.when(ext.isin(*exts), lang)
    return out.otherwise("other")


def parse_policy(path: Column, size: Column, max_bytes: int) -> Column:
    bundle = (size > BUNDLE_BYTES) | F.lower(name_of(path)).rlike("|".join(map(re.escape, BUNDLE_HINTS)))
    return F.when(size > max_bytes, "skip_size").when(extension(path).isin(*LANGUAGES["javascript"]) & bundle, "skip_size").otherwise("parse")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "[REDACTED]")


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), 1, 200)


def report_name(name: Column, ident: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), 1, 80), F.lit("_"), F.substring(ident, 1, 8), F.lit(".pdf"))


def escaped(text: Column, most: int = 240) -> Column:
    t = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def vuln_type(rule_id: Column) -> Column:
    t = F.regexp_extract(rule_id, "^RULE-([A-Z0-9]+)-", 1)
    return F.when(t != "", t).otherwise("OTHER")


def title(rule_id: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv))
    return F.coalesce(F.try_element_at(labels, vuln_type(rule_id)), rule_id)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)), F.lit(len(SEVERITIES) + 1)).cast("int")


def at_least(version: Column, least: Column) -> Column:
    """As strings, so 10 is less than 3.1."""
    return version >= least


def glob_regex(glob: str) -> str:
    """The regular expression of a shell pattern whose stars also cross folders."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", glob)) + "$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    return F.coalesce(path.rlike("|".join(map(glob_regex, globs))), F.lit(False))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def repository(url: Column) -> Column:
    """owner/name of a repository URL, null for others."""
    found = F.regexp_extract(url, r"^(?:https?://|git@)[^/:]+[/:]([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1)
    return F.when(found != "", found)


def token_problem(token: Column) -> Column:
    """Why a token can't be used: URL_OR_PATH or FORMAT; null for one that can, and for none (null or blank)."""
    t = F.trim(token)
    return F.when(t == "", None).when(t.rlike(r"://|[@/: ]"), "URL_OR_PATH").when(~t.rlike(TOKEN), "FORMAT")


def http_problem(status: Column, body: Column | None = None) -> Column:
    """What a code host's answer says: null for 200, else AUTH, or HTTP; of downloads, whose body is given, also NOT_FOUND and RATE_LIMIT."""
    out = F.when(status == 200, None).when(status == 401, "AUTH")
    if body is not None:
        out = out.when(status == 404, "NOT_FOUND").when((status == 403) & F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit("rate limit")), "RATE_LIMIT")
    return out.otherwise("HTTP")


def valid_finding_id(ident: Column) -> Column:
    return ident.rlike(FINDING_ID)


def label_name(label: Column) -> Column:
    """A graph-store label: other signs than letters, digits and _ are dropped."""
    return F.regexp_replace(label, "[^A-Za-z0-9_]", "")


def workers(cpus: Column, ram_gb: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), cpus - 2), F.greatest(F.lit(1), F.floor(ram_gb / 2)), F.lit(16))).cast("int")


def in_flight(n: Column, ram_gb: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(n, F.least(n * 2, ram_gb * 2, F.lit(32)))).cast("int")


def sha(text: Column, n: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def canonical(json: Column) -> Column:
    """JSON as Spark writes it, with all that isn't printable ASCII as \\uXXXX (pairs beyond the basic plane) and hexadecimal digits in lower
    case, so that digests equal those of writers that keep to ASCII. Fields must be in order already."""
    out = json
    for c in "ABCDEF":  # of control characters only; an escaped backslash before a `u` is none
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\u00([01])" + c, r"$1\\u00$2" + c.lower())
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c: Column) -> Column:
        n, above = F.ascii(c), F.ascii(c) - 0x10000
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(above, 10)), unit(F.lit(0xDC00) + above.bitwiseAND(0x3FF)))
        return F.when(n < 127, c).when(n < 0x10000, unit(n)).otherwise(pair)

    ascii_only = F.array_join(F.transform(F.split(out, ""), escaped), "")
    return F.when(json.rlike(r"[^\x00-\x7E]"), ascii_only).when(json.contains("\\u00"), out).otherwise(json)


def edge_id(src: Column, rel: Column, dst: Column, props_json: Column | None = None) -> Column:
    return F.concat(F.lit("e:"), sha(F.concat(src, F.lit("\0"), rel, F.lit("\0"), dst, F.lit("\0"), F.lit("{}") if props_json is None else props_json), 16))


def finding_id(rule: Column, anchor: Column, sink: Column, witness_hash: Column) -> Column:
    return F.concat_ws("|", F.lit("FINDING"), rule, anchor, sink, witness_hash)


def missing_keys(text: Column, *keys: str) -> Column:
    """Those of the keys that a JSON object lacks; null where the text is no JSON object."""
    return F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(text))
