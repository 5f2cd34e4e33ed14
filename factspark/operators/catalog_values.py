"""The patterns of the built-in catalogs and the markers of paths that code fixes. They must stay as they are for
results to be comparable, so they are given as they stand, in their order, and are data only.

Each entry: label, pattern, properties."""

GENERIC = (
    ("Source", r"\$_(GET|POST|REQUEST)\b", {"kind": "HTTP_SUPERGLOBAL", "context": "HTTP_INPUT"}),
    ("Source", r"\$_(COOKIE|SERVER)\b", {"kind": "HTTP_SUPERGLOBAL", "context": "HTTP_INPUT"}),
    ("Source", r"\bphp://input\b", {"kind": "HTTP_BODY", "context": "HTTP_INPUT", "name": "php://input"}),
    ("Source", r"\$_(FILES)\b", {"kind": "HTTP_UPLOAD", "context": "HTTP_INPUT"}),
    ("Source", r"\bgetenv\s*\(", {"kind": "ENV", "context": "HTTP_INPUT"}),
    ("Source", r"\$argv\b", {"kind": "CLI_ARG", "context": "CLI"}),
    ("Sink", r"\b(PDO|mysqli)\s*::\s*query\s*\(", {"kind": "SQL", "context": "SQL", "api": "pdo_static_query"}),
    ("Sink", r"\$[a-zA-Z_][a-zA-Z0-9_]*\s*->\s*query\s*\(", {"kind": "SQL", "context": "SQL", "api": "pdo_query"}),
    ("Sink", r"\$wpdb\s*->\s*query\s*\(", {"kind": "SQL", "context": "SQL", "api": "wpdb_query"}),
    ("Sink", r"\$wpdb\s*->\s*(get_results|get_var|get_row)\s*\(", {"kind": "SQL", "context": "SQL"}),
    ("Sink", r"\bmysqli_query\s*\(", {"kind": "SQL", "context": "SQL", "api": "mysqli_query"}),
    ("Sink", r"\becho\s+", {"kind": "HTML", "context": "HTML", "api": "echo"}),
    ("Sink", r"\b(print|printf)\s*\(", {"kind": "HTML", "context": "HTML"}),
    ("Sink", r"\b(header|wp_safe_redirect)\s*\(", {"kind": "REDIRECT", "context": "URL"}),
    ("Sink", r"(?<![A-Za-z0-9_])(include|require)(_once)?(\s*\(|\s+)", {"kind": "FILE_INCLUDE", "context": "FILE"}),
    ("Sink", r"\b(file_get_contents|readfile|fopen)\s*\(", {"kind": "REMOTE_READ", "context": "FILE"}),
    ("Sink", r"\b(file_put_contents|unlink)\s*\(", {"kind": "FILE_WRITE", "context": "FILE"}),
    ("Sink", r"\b(eval|assert|shell_exec|system|passthru|exec|proc_open)\s*\(", {"kind": "CODE_EXEC", "context": "SHELL"}),
    ("Sink", r"\b(move_uploaded_file|wp_handle_upload)\s*\(", {"kind": "UPLOAD", "context": "FILE"}),
    ("Sink", r"\b(curl_exec|curl_setopt)\s*\(", {"kind": "HTTP_CLIENT", "context": "SSRF"}),
    ("Sink", r"\bwp_remote_(get|post|request)\s*\(", {"kind": "HTTP_CLIENT", "context": "SSRF"}),
    ("Sink", r"\bfputcsv\s*\(", {"kind": "CSV_OUTPUT", "context": "CSV"}),
    ("Sink", r"\bunserialize\s*\(", {"kind": "OBJECT_INJECTION", "context": "DESERIALIZE"}),
    ("Sanitizer", r"\$wpdb\s*->\s*prepare\s*\(", {"kind": "SQL_PREPARE", "name": "wpdb_prepare", "context": "SQL"}),
    ("Sanitizer", r"\b(PDO|mysqli).*->\s*prepare\s*\(", {"kind": "SQL_PREPARE", "context": "SQL"}),
    ("Sanitizer", r"\b(htmlspecialchars|filter_var|intval|mysqli_real_escape_string)\s*\(", {"kind": "SANITIZE", "context": "HTML"}),
)
PLATFORM = (
    ("Sink", r"\bwp_redirect\s*\(", {"kind": "REDIRECT", "context": "URL", "api": "wp_redirect"}),
    ("Sanitizer", r"\b(esc_html|esc_attr|esc_url|esc_js|wp_kses_post|sanitize_text_field|esc_url_raw|sanitize_file_name)\s*\(", {"kind": "SANITIZE", "context": "HTML"}),
)
#: Heuristics over a file as a whole: name, and what must all occur. Requirements that name GET take either case.
HEURISTICS = (
    ("NONCE_GET_ONLY", (r"\$_REQUEST\s*\[\s*['\"]option['\"]\s*\]", r"['\"]GET['\"]\s*===\s*\$_SERVER", "wp_verify_nonce")),
)

#: All three take either case.
STATIC_PATH_MARKERS = r"__DIR__|ABSPATH|plugin_dir_path|dirname\s*\(\s*__FILE__"
STATIC_INCLUDE_ARGUMENT = r"\b(include|require)(_once)?\s*(\(\s*['\"]|['\"]\s*\)|\s+['\"])"
STATIC_INCLUDE_CALL = r"require(_once)?\s+.*__DIR__|plugin_dir_path|dirname\s*\(\s*__FILE__"

#: Sanitizers by the context they clean.
URL_SANITIZERS = ("esc_url", "esc_url_raw", "sanitize_file_name", "sanitize_text_field")
GENERIC_SANITIZERS = ("sanitize_email", "absint", "htmlspecialchars", "filter_var", "intval")
