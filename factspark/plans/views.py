"""Views that give the generated tables the shapes the operators take, in Spark and (CTES) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXTENSIONS = ("php", "js", "html", "min.js", "txt", "inc")
SINKS = ("SQL", "HTML", "REDIRECT", "FILE_INCLUDE", "REMOTE_READ", "CODE_EXEC", "UPLOAD", "HTTP_CLIENT", "CSV_OUTPUT", "OBJECT_INJECTION")
CONTEXTS = ("SQL", "HTML", "URL", "GENERIC", "UNKNOWN")
NAMES = ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER")
RULES = ("SQLI", "XSS", "REDIRECT", "LFI", "RFI", "RCE", "UPLOAD", "SSRF", "CSV", "OBJINJ", "WP-NONCE", "WP-AJAX", "WP-REST", "WP-IDOR")


#: Small programs by doc_id modulo their number. Each follows the document's text in a comment, so the lexer reads that too.
PROGRAMS = (
    "$id = $_GET['id'];\n$rows = $db->query(\"SELECT $id\");\n",
    "$n = $_POST['n'];\necho htmlspecialchars($n);\n",
    "$x = $_COOKIE['x'];\nsystem($x);\n$y = $_GET['y'];\nexec($y);\n",
    "add_action('wp_ajax_nopriv_a', 'b');\n",
    "current_user_can('x');\nadd_action('wp_ajax_nopriv_a', 'b');\n$o = unserialize($_POST['o']);\n",
    "register_rest_route('a', 'b', array('permission_callback' => '__return_true'));\n$f = $_REQUEST['f'];\ninclude $f;\n",
    "$q = $_GET['q'];\n$s = $wpdb->prepare($q);\n$wpdb->query($s);\nwp_verify_nonce($n);\n",
    "function go(a) { return helper(a); }\n",
)

#: What the programs of `programs` are made of: cleaners, sinks in the order of SINKS, and lines after them.
CLEANERS = ("$j = 2;", "$s = $wpdb->prepare($q);", "$w = esc_html($v);", "$w = esc_url($v);")
SINK_LINES = ("mysqli_query($c, $v);", "echo $v;", "header($v);", "include PATH;", "readfile(PATH);", "system($v);", "move_uploaded_file($v, $t);", "curl_exec($v);", "fputcsv($f, $v);")
MORE_LINES = ("$z = 3;", "add_action('wp_ajax_nopriv_x', 'f');", "current_user_can('x');", "register_rest_route('a', 'b', array('permission_callback' => '__return_true'));", "$o = $_REQUEST['option']; $m = 'GET' === $_SERVER['REQUEST_METHOD']; wp_verify_nonce($n);", "unserialize($v);")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _pick(self, values: tuple[str, ...], index) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))

    def files(self) -> DataFrame:
        d = self.table("documents")
        path = F.concat_ws("/", "source", "lang", F.concat_ws(".", F.col("doc_id").cast("string"), self._pick(EXTENSIONS, F.col("doc_id") % 6)))
        return d.select(F.col("doc_id").alias("ord"), path.alias("rel_path"), "text", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))

    def code(self) -> DataFrame:
        """rel_path, text, size: every document's text in a comment, with a program below it (the last one JavaScript)."""
        d = self.table("documents")
        k = F.col("doc_id") % len(PROGRAMS)
        comment = F.concat(F.lit("/*"), F.replace("text", F.lit("*/"), F.lit("")), F.lit("*/\n"))
        text = F.concat(F.when(k == 7, "").otherwise("<?php\n"), comment, self._pick(PROGRAMS, k))
        rows = d.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(k == 7, ".js").otherwise(".php")).alias("rel_path"), text.alias("text"))
        return rows.withColumn("size", F.octet_length("text").cast("long"))

    def programs(self) -> DataFrame:
        """rel_path, text, size: every document's text in a comment, below it a source, what may clean it, a gap, a sink and one line
        more, all chosen by the id."""
        d, k = self.table("documents"), F.col("doc_id")
        pick = lambda values, i: self._pick(values, i)
        fixed = F.when((F.floor(k / 11) % 2 == 1), True).otherwise(False)
        sink = F.floor(k / 5) % 9
        path = F.when(fixed & sink.isin(3, 4), "__DIR__ . $v").otherwise("$v")
        lines = F.concat(
            F.lit("$v = "), pick(NAMES, k % 5), F.lit("['k'];\n"),
            pick(CLEANERS, F.floor(k / 3) % 4), F.lit("\n"), F.repeat(F.lit("$i = 1;\n"), (k % 3).cast("int")),
            F.replace(pick(SINK_LINES, sink), F.lit("PATH"), path), F.lit("\n"), pick(MORE_LINES, F.floor(k / 7) % 6), F.lit("\n"),
        )
        rows = d.where(k.isNotNull()).select(F.concat(F.lit("p"), k.cast("string"), F.lit(".php")).alias("rel_path"), F.concat(F.lit("<?php\n/*"), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("")), F.lit("*/\n"), lines).alias("text"))
        return rows.withColumn("size", F.octet_length("text").cast("long"))

    def lines(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n"))).select("file", (F.col("pos") + 1).alias("line"), F.lit(0).alias("byte_off"), F.col("col").alias("text"))

    def tags(self) -> DataFrame:
        p = self.table("pages")
        return p.select(F.col("page_id").alias("file"), F.posexplode(F.regexp_extract_all("html", F.lit("(</?[a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))).select("file", (F.col("pos") + 1).alias("line"), F.lit(0).alias("byte_off"), F.col("col").alias("text"))

    def spans(self) -> DataFrame:
        """Opened tags of a few kinds, each to the next closing tag of its kind."""
        t = self.tags()
        name = F.lower(F.regexp_replace("text", "[</]", ""))
        t = t.withColumns({"kind": name, "closes": F.col("text").startswith("</")}).where(F.col("kind").isin("ul", "li", "p", "a"))
        w = Window.partitionBy("file", "kind").orderBy(F.desc("line"))
        t = t.withColumn("end", F.last(F.when(F.col("closes"), F.col("line")), True).over(w))
        return t.where("not closes and end is not null").select("file", F.concat_ws(":", "kind", F.col("line").cast("string")).alias("id"), F.col("line").alias("start"), "end", "kind")

    def facts(self) -> DataFrame:
        e = self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        k, kind = F.col("k"), F.col("event_type")
        other = F.when(k % 40 == 0, "CapabilityCheck").when(k % 4 == 1, "AjaxAction").when(k % 4 == 2, "GuardCheck").otherwise("Other")
        label = F.when(kind.isin("view", "click"), "Source").when(kind == "purchase", "Sink").when(kind == "error", "Sanitizer").otherwise(other)
        return e.select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"),
            F.col("event_id").alias("ord"),
            F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("id"),
            (F.floor((n - 1) / 3) + 1).cast("int").alias("line"),
            label.alias("label"),
            F.when(label == "Source", "HTTP_SUPERGLOBAL").when(label == "Sink", self._pick(SINKS, k % 10)).when((label == "Sanitizer") & (k % 30 == 4), "SQL_PREPARE").when(label == "Sanitizer", "SANITIZE").alias("kind"),
            self._pick(CONTEXTS, k % 5).alias("context"),
            self._pick(NAMES, k % 5).alias("name"),
            (k % 7 == 0).alias("static"),
            k,
        )

    def scans(self) -> DataFrame:
        o = self.table("orders")
        status = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("QUEUED")
        return o.select(F.col("o_orderkey").alias("scan_id"), F.concat(F.lit("slug-"), F.col("o_custkey").cast("string")).alias("slug"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_orderpriority").alias("source_label"))

    def findings(self) -> DataFrame:
        f = self.table("lineitem")
        flags = F.concat("l_returnflag", "l_linestatus")
        severity = F.when(flags == "RF", "CRITICAL").when(flags == "AF", "HIGH").when(flags == "NO", "MEDIUM").when(flags == "RO", "LOW").otherwise("INFO")
        score = F.round(F.col("l_discount") * 10, 2)
        return f.select(
            F.col("l_orderkey").alias("scan_id"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("finding_id"),
            F.concat(F.lit("RULE-"), self._pick(RULES, F.col("l_partkey") % 14), F.lit("-001")).alias("rule_id"),
            severity.alias("severity"),
            F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file"),
            F.col("l_linenumber").alias("sink_line"),
            F.col("l_quantity").cast("int").alias("source_line"),
            score.alias("score"),
            F.when(score >= 0.85, "VERY_HIGH").when(score >= 0.65, "HIGH").when(score >= 0.45, "MEDIUM").when(score >= 0.25, "LOW").otherwise("VERY_LOW").alias("bucket"),
            (F.col("l_tax") > 0.04).alias("downgraded"),
            (F.col("l_tax") > 0.07).alias("blocked"),
        )

    def candidates(self) -> DataFrame:
        """Findings whose witnesses are built from the columns, so that all cases of skeptic, checks and score occur."""
        f = self.table("lineitem")
        pk, sk, ln, q = (F.col(c).cast("long") for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
        some = lambda by, *lists: F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in lists)), (by + 1).cast("int"))
        limits = some(sk % 5, (), ("exposure_not_gated",), ("interprocedural_heuristic",), ("coarse_taint_approximation", "x"), ("",))
        trace = some(pk % 4, (), ("graph:x",), ("graph:x", "MISSING_GUARD:y"), ("x", "lift_derived_flow"))
        hop = F.struct(F.lit("FLOWS_TO").alias("edge_kind"), F.lit("a").alias("from_id"), F.lit("b").alias("to_id"))
        summary = F.struct(
            F.when(pk % 3 == 0, True).alias("approximate_flow"),
            F.when(ln % 2 == 0, q * 2.0).when(ln % 3 == 0, q / 100).alias("constraint_strength"),
            F.lit(None).cast("long").alias("source_count"),
            F.when(sk % 7 == 0, True).alias("sql_prepare_on_path"),
            F.when(sk % 2 == 0, ln % 3).cast("int").alias("unresolved_calls"),
        )
        witness = F.struct(limits.alias("analysis_limits"), summary.alias("constraint_summary"), F.array_repeat(F.lit("e"), (ln % 3).cast("int")).alias("path_edges"), trace.alias("semantic_trace"), F.array_repeat(hop, (sk % 3).cast("int")).alias("summary_hops"), F.array().cast("array<string>").alias("taint_labels"))
        return f.select(
            F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("finding_id"),
            F.concat(F.lit("RULE-"), self._pick(RULES, pk % 14), F.lit("-001")).alias("rule_id"),
            self._pick(("a.graph_flow", "a.coarse", "a.pattern"), sk % 3).alias("title_key"),
            F.when(ln % 4 != 0, q.cast("int")).alias("source_line"),
            (ln - F.when(sk % 11 == 0, 1).otherwise(0)).cast("int").alias("sink_line"),
            (sk % 2 == 0).alias("ajax_nopriv"),
            witness.alias("witness"),
        )

    def jobs(self) -> dict[str, DataFrame]:
        """What database, memory, logs, output folders and queue say of scans."""
        o, items = self.table("orders"), self.table("lineitem")
        key, cust, part, supp = (F.col(c) for c in ("o_orderkey", "o_custkey", "l_partkey", "l_suppkey"))
        text = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
        recorded = o.where(key % 5 != 0).select(
            key.alias("scan_id"), F.when(cust % 4 == 0, "").otherwise(text("slug", cust)).alias("slug"), F.when(key % 3 == 0, "COMPLETED").when(key % 3 == 1, "RUNNING").otherwise("QUEUED").alias("status"), F.when(cust % 9 != 0, F.col("o_orderdate").cast("timestamp")).alias("started_at"),
            (cust % 10).alias("findings"), F.when(key % 8 == 0, "").when(key % 8 == 1, "broke").alias("error"), F.when(key % 2 == 0, text("db/", key)).alias("output_dir"),
        )
        memory = o.where((cust % 3 == 0) & (cust % 12 != 0)).select(
            key.alias("scan_id"), text("mem", cust).alias("slug"), F.when(cust % 11 != 0, self._pick(("QUEUED", "RUNNING", "COMPLETED", "FAILED", "ODD"), cust % 5)).alias("status"), F.when(cust % 2 == 0, text("step ", cust % 7)).alias("progress"),
            F.when(cust % 6 != 0, cust % 13).alias("findings"), F.when(cust % 7 == 0, "lost").alias("error"), F.when(cust % 4 == 0, text("mem/", key)).otherwise("").alias("output_dir"),
        )
        log = items.select(
            F.col("l_orderkey").alias("scan_id"), F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")), F.col("l_quantity").cast("int").cast("string")).alias("at"), F.when(F.col("l_returnflag") == "R", "RUNNING").when(F.col("l_returnflag") == "A", "").otherwise("QUEUED").alias("status"), F.when(supp % 3 != 0, text("stage ", supp % 4)).alias("stage"),
            F.when(supp % 4 == 0, text("detail ", part % 5)).otherwise("").alias("detail"), F.when(part % 3 == 0, "x").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("progress_pct"), F.when(part % 10 == 0, "bad").alias("error"),
        )
        artifacts = o.where(key % 4 != 1).select(key.alias("scan_id"), text("out/", key).alias("output_dir"), F.when(key % 7 == 0, cust % 50).alias("findings"))
        return {"recorded": recorded, "memory": memory, "log": log, "artifacts": artifacts, "queue": o.where(cust % 6 < 3).select(key.alias("scan_id"), (cust % 3).alias("position"))}

    def nodes(self) -> DataFrame:
        part = lambda t, key, label, tag, keep="true": self.table(t).where(keep).select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"))
        return part("region", "r_regionkey", "File", "r").union(part("nation", "n_nationkey", "Function", "n", "n_nationkey <> 3")).union(part("customer", "c_custkey", "Callsite", "c")).union(part("supplier", "s_suppkey", "Route", "s"))

    def edges(self) -> DataFrame:
        part = lambda t, a, ta, rel, b, tb, keep="true": self.table(t).where(keep).select(F.concat(F.lit(ta), F.col(a).cast("string")).alias("src"), F.lit(rel).alias("rel"), F.concat(F.lit(tb), F.col(b).cast("string")).alias("dst"))
        return (
            part("nation", "n_regionkey", "r", "CONTAINS", "n_nationkey", "n")
            .union(part("customer", "c_custkey", "c", "CALLS", "c_nationkey", "n"))
            .union(part("supplier", "s_suppkey", "s", "DEFINED_IN", "s_nationkey", "n"))
            .union(part("supplier", "s_suppkey", "s", "MISSING_GUARD", "s_nationkey", "n", "s_acctbal < 1000"))
        )

    def program(self) -> tuple[DataFrame, DataFrame]:
        """Functions (suppliers; some share a name, a file and even a line) and their calls (customers; some of unknown callees)."""
        text = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
        s, c = self.table("supplier"), self.table("customer")
        key, caller = F.col("c_custkey"), F.col("c_custkey") % 60 + 1
        none = F.lit(None).cast("string")
        symbol = text("Supplier", (caller % 7 + 7 * (F.floor(key / 60) % 9)) % 40)  # mostly of the caller's file
        functions = s.select(text("fn", F.col("s_suppkey")).alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "Method").otherwise("Function").alias("label"), text("Supplier", F.col("s_suppkey") % 40).alias("name"), none.alias("kind"), text("f", F.col("s_suppkey") % 7).alias("file"), (F.col("s_suppkey") % 25).cast("int").alias("line"))
        sites = c.select(text("c", key), F.lit("Callsite"), F.lit("x"), none, text("f", caller % 7), (key % 30).cast("int"))
        symbols = c.where(key % 5 != 0).select(F.concat(F.lit("sym:"), symbol), F.lit("Symbol"), symbol, none, none, F.lit(None).cast("int")).distinct()
        edges = c.select(text("fn", caller).alias("src"), F.lit("CALLS").alias("rel"), text("c", key).alias("dst")).union(c.where(key % 5 != 0).select(text("c", key), F.lit("CALLS_TARGET"), F.concat(F.lit("sym:"), symbol)))
        return functions.union(sites).union(symbols), edges

    def base_and_target(self) -> tuple[DataFrame, DataFrame]:
        d = self.table("documents").select(F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("rel_path"), "doc_id", "text")
        base = d.where("doc_id % 10 <> 0").select("rel_path", F.sha2("text", 256).alias("sha256"))
        new = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
        return base, d.where("doc_id % 7 <> 0").select("rel_path", F.sha2(new, 256).alias("sha256"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CTES = {
    "v_files": f"""SELECT doc_id AS ord, source || '/' || lang || '/' || doc_id || '.' || {_list(EXTENSIONS)}[doc_id % 6 + 1] AS rel_path, text, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents""",
    # first: the line on which a document's program begins
    "v_code": "SELECT 'f' || doc_id || CASE WHEN doc_id % 8 = 7 THEN '.js' ELSE '.php' END AS file, doc_id % 8 AS k, CAST(CASE WHEN doc_id % 8 = 7 THEN 2 ELSE 3 END + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS first FROM documents",
    # first: the line of the source; sink: its number among SINKS
    "v_programs": """SELECT 'p' || doc_id || '.php' AS file, doc_id % 5 AS source, doc_id // 3 % 4 AS cleaner, CAST(doc_id % 3 AS INTEGER) AS gap, doc_id // 5 % 9 AS sink, doc_id // 11 % 2 = 1 AND doc_id // 5 % 9 IN (3, 4) AS fixed, doc_id // 7 % 6 AS more,
      CAST(3 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INTEGER) AS first FROM documents WHERE doc_id IS NOT NULL""",
    "v_lines": "SELECT doc_id AS file, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "v_tags": "SELECT page_id AS file, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT page_id, regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*') AS l FROM pages)",
    "v_facts": f"""SELECT 'u' || user_id AS file, event_id AS ord, 'n' || event_id AS id, CAST((rn - 1) // 3 + 1 AS INTEGER) AS line, label,
      CASE WHEN label = 'Source' THEN 'HTTP_SUPERGLOBAL' WHEN label = 'Sink' THEN {_list(SINKS)}[k % 10 + 1] WHEN label = 'Sanitizer' AND k % 30 = 4 THEN 'SQL_PREPARE' WHEN label = 'Sanitizer' THEN 'SANITIZE' END AS kind,
      {_list(CONTEXTS)}[k % 5 + 1] AS context, {_list(NAMES)}[k % 5 + 1] AS name, k % 7 = 0 AS static, k
      FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'Source' WHEN event_type = 'purchase' THEN 'Sink' WHEN event_type = 'error' THEN 'Sanitizer' WHEN k % 40 = 0 THEN 'CapabilityCheck' WHEN k % 4 = 1 THEN 'AjaxAction' WHEN k % 4 = 2 THEN 'GuardCheck' ELSE 'Other' END AS label,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "v_scans": "SELECT o_orderkey AS scan_id, 'slug-' || o_custkey AS slug, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'COMPLETED' ELSE 'QUEUED' END AS status, o_orderdate AS started_at, o_orderpriority AS source_label FROM orders",
    "v_findings": f"""SELECT *, CASE WHEN score >= 0.85 THEN 'VERY_HIGH' WHEN score >= 0.65 THEN 'HIGH' WHEN score >= 0.45 THEN 'MEDIUM' WHEN score >= 0.25 THEN 'LOW' ELSE 'VERY_LOW' END AS bucket FROM (
      SELECT l_orderkey AS scan_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS finding_id, 'RULE-' || {_list(RULES)}[l_partkey % 14 + 1] || '-001' AS rule_id,
      CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'CRITICAL' WHEN 'AF' THEN 'HIGH' WHEN 'NO' THEN 'MEDIUM' WHEN 'RO' THEN 'LOW' ELSE 'INFO' END AS severity, 'f' || l_suppkey AS file, l_linenumber AS sink_line, CAST(l_quantity AS INTEGER) AS source_line,
      round(l_discount * 10, 2) AS score, l_tax > 0.04 AS downgraded, l_tax > 0.07 AS blocked FROM lineitem)""",
    "v_nodes": "SELECT 'r' || r_regionkey AS id, 'File' AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'Function' FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'c' || c_custkey, 'Callsite' FROM customer UNION ALL SELECT 's' || s_suppkey, 'Route' FROM supplier",
    "v_edges": "SELECT 'r' || n_regionkey AS src, 'CONTAINS' AS rel, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'CALLS', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'DEFINED_IN', 'n' || s_nationkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'MISSING_GUARD', 'n' || s_nationkey FROM supplier WHERE s_acctbal < 1000",
    "v_base": "SELECT 'p/' || doc_id AS rel_path, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 <> 0",
    "v_target": "SELECT 'p/' || doc_id AS rel_path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS sha256 FROM documents WHERE doc_id % 7 <> 0",
    "v_spans": "SELECT file, kind || ':' || line AS id, line AS start, e AS \"end\", kind FROM (SELECT *, min(CASE WHEN closes THEN line END) OVER (PARTITION BY file, kind ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM (SELECT file, line, lower(regexp_replace(text, '[</]', '', 'g')) AS kind, starts_with(text, '</') AS closes FROM v_tags) WHERE kind IN ('ul', 'li', 'p', 'a')) WHERE NOT closes AND e IS NOT NULL",
    # every sink with its nearest source: of those at or above it the lowest, of one line the first
    "v_near": "SELECT k.file, s.id AS src, k.id AS dst, s.line AS source_line, k.line AS sink_line, k.ord AS sink_ord, k.kind AS sink_kind, s.name AS source_name, k.static AS sink_static FROM v_facts k JOIN v_facts s ON s.file = k.file AND s.label = 'Source' AND s.line <= k.line WHERE k.label = 'Sink' QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY s.line DESC, s.ord) = 1",
    "v_stop": """SELECT n.dst, a.id AS san, a.line, a.ord FROM v_near n JOIN v_facts a ON a.file = n.file AND a.label = 'Sanitizer' AND a.line > n.source_line AND a.line <= n.sink_line AND (
      n.sink_kind = 'SQL' AND (a.context = 'SQL' OR a.kind = 'SQL_PREPARE') OR n.sink_kind = 'HTML' AND a.context IN ('HTML', 'GENERIC')
      OR n.sink_kind IN ('REDIRECT', 'FILE_INCLUDE', 'REMOTE_READ', 'UPLOAD', 'FILE_WRITE') AND (a.context IN ('URL', 'GENERIC') OR a.name IN ('esc_url', 'esc_url_raw', 'sanitize_file_name', 'sanitize_text_field')) OR n.sink_kind = 'HTTP_CLIENT' AND a.context IN ('URL', 'GENERIC'))""",
    "v_flows": "SELECT * FROM v_near WHERE dst NOT IN (SELECT dst FROM v_stop)",
    "v_recorded": "SELECT o_orderkey AS scan_id, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'slug' || o_custkey END AS slug, CASE o_orderkey % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'RUNNING' ELSE 'QUEUED' END AS status, CASE WHEN o_custkey % 9 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS started_at, o_custkey % 10 AS findings, CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'broke' END AS error, CASE WHEN o_orderkey % 2 = 0 THEN 'db/' || o_orderkey END AS output_dir FROM orders WHERE o_orderkey % 5 <> 0",
    "v_memory": "SELECT o_orderkey AS scan_id, 'mem' || o_custkey AS slug, CASE WHEN o_custkey % 11 <> 0 THEN ['QUEUED', 'RUNNING', 'COMPLETED', 'FAILED', 'ODD'][o_custkey % 5 + 1] END AS status, CASE WHEN o_custkey % 2 = 0 THEN 'step ' || o_custkey % 7 END AS progress, CASE WHEN o_custkey % 6 <> 0 THEN o_custkey % 13 END AS findings, CASE WHEN o_custkey % 7 = 0 THEN 'lost' END AS error, CASE WHEN o_custkey % 4 = 0 THEN 'mem/' || o_orderkey ELSE '' END AS output_dir FROM orders WHERE o_custkey % 3 = 0 AND o_custkey % 12 <> 0",
    "v_log": "SELECT l_orderkey AS scan_id, CASE l_returnflag WHEN 'R' THEN 'RUNNING' WHEN 'A' THEN '' ELSE 'QUEUED' END AS status, CASE WHEN l_suppkey % 3 <> 0 THEN 'stage ' || l_suppkey % 4 END AS stage, CASE WHEN l_suppkey % 4 = 0 THEN 'detail ' || l_partkey % 5 ELSE '' END AS detail, CASE WHEN l_partkey % 3 <> 0 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS pct, CASE WHEN l_partkey % 10 = 0 THEN 'bad' END AS error FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag || '-' || CAST(l_quantity AS INTEGER) DESC) = 1",
    "v_artifacts": "SELECT o_orderkey AS scan_id, 'out/' || o_orderkey AS output_dir, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 50 END AS findings FROM orders WHERE o_orderkey % 4 <> 1",
    "v_queue": "SELECT o_orderkey AS scan_id, o_custkey % 3 AS position FROM orders WHERE o_custkey % 6 < 3",
    "v_candidates": f"""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS finding_id, 'RULE-' || {_list(RULES)}[l_partkey % 14 + 1] || '-001' AS rule_id, ['a.graph_flow', 'a.coarse', 'a.pattern'][l_suppkey % 3 + 1] AS title_key,
      CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_quantity AS INTEGER) END AS source_line, CAST(l_linenumber - CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS sink_line, l_suppkey % 2 = 0 AS ajax, l_suppkey % 5 AS limits, l_partkey % 4 AS trace, l_partkey % 3 = 0 AS approx,
      CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) * 2.0 WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity AS BIGINT) / 100 ELSE 0 END::DOUBLE AS strength, l_suppkey % 7 = 0 AS prepared, CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber % 3 ELSE 0 END AS open, l_linenumber % 3 AS edges, l_suppkey % 3 AS hops FROM lineitem""",
    "v_functions": "SELECT 'fn' || s_suppkey AS id, 'Supplier' || s_suppkey % 40 AS name, 'f' || s_suppkey % 7 AS file, s_suppkey % 25 AS line FROM supplier",
    "v_calls": """SELECT fn.name AS caller, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'Supplier' || ((c_custkey % 60 + 1) % 7 + 7 * (c_custkey // 60 % 9)) % 40 END AS callee, 'f' || (c_custkey % 60 + 1) % 7 AS file, c_custkey % 30 AS line,
      CASE WHEN c_custkey % 5 <> 0 AND 'Supplier' || ((c_custkey % 60 + 1) % 7 + 7 * (c_custkey // 60 % 9)) % 40 IN (SELECT name FROM v_functions) THEN 'STATIC' ELSE 'UNKNOWN' END AS resolution FROM customer JOIN v_functions fn ON fn.id = 'fn' || (c_custkey % 60 + 1)""",
    "v_last": "SELECT file, name, 'bb:' || file || ':' || name || ':' || max(line) AS block FROM v_functions GROUP BY file, name",
    "v_branches": """SELECT coalesce(a.block, 'bb:' || c.file || ':' || caller || ':0') AS src, coalesce(b.block, 'bb:' || c.file || ':' || callee || ':0') AS dst, CASE resolution WHEN 'STATIC' THEN 'NEXT' ELSE 'UNKNOWN_BRANCH' END AS rel
      FROM v_calls c LEFT JOIN v_last a ON a.file = c.file AND a.name = caller LEFT JOIN v_last b ON b.file = c.file AND b.name = callee""",
    "v_merges": "SELECT dst AS block, string_agg(DISTINCT src, ',' ORDER BY src) AS preds FROM v_branches WHERE dst IN (SELECT 'bb:' || file || ':' || name || ':' || line FROM v_functions) GROUP BY dst HAVING count(DISTINCT src) > 1",
}
#: What each view reads, so that a query carries only its own.
NEEDS = {"v_spans": ("v_tags",), "v_near": ("v_facts",), "v_stop": ("v_facts", "v_near"), "v_flows": ("v_facts", "v_near", "v_stop"), "v_merges": ("v_functions", "v_calls", "v_last", "v_branches")}


def sql(body: str, *views: str) -> str:
    used: list[str] = []
    for v in views:
        for x in (*NEEDS.get(v, ()), v):
            if x not in used:
                used.append(x)
    return "WITH " + ",\n".join(f"{v} AS ({CTES[v]})" for v in used) + "\n" + body if used else body
