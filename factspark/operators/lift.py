"""Source texts to spans: a tolerant lexer for PHP, JavaScript and HTML, run over Arrow batches.

There is no grammar: a token pass skips strings, comments and HTML islands, brackets are matched on a stack, and declarations
and calls become spans. What can't be matched ends with the file and yields a diagnostic; no text makes a batch fail.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "file string, id string, kind string, label string, start_byte int, end_byte int, start_line int, start_col int, end_line int, end_col int, parent string, ord int, diagnostic string"
LANGUAGES = ("php", "javascript", "html")
BUDGET = 250_000
ROWS = 2_048
# What a span's order of importance is when the budget runs out: declarations, then calls, then the rest.
TIERS = (("class_declaration", "function_definition", "method_declaration"), ("function_call_expression", "member_call_expression", "scoped_call_expression"))
INCLUDES = {"include": "include_expression", "include_once": "include_once_expression", "require": "require_expression", "require_once": "require_once_expression"}
NOT_CALLS = {"if", "for", "foreach", "while", "switch", "catch", "function", "return", "array", "list", "isset", "empty", "fn", "match", "elseif", "declare", "and", "or", "new", "echo", "print", "typeof", "await", "yield", "throw", "else", "case", "in", "of", "do", *INCLUDES}
# What a statement begins with that is no expression; those of the second set are followed by another statement.
STATEMENTS = {"return", "break", "continue", "throw", "global", "static", "namespace", "use", "const", "public", "private", "protected", "abstract", "final", "class", "interface", "trait", "function", "case", "default", "var", "let", "import", "export", "echo", "goto", "unset", "if", "elseif", "while", "for", "foreach", "switch", "catch", "declare", *INCLUDES}
LEADS = {"else", "do", "try", "finally"}
BEFORE_PARENTHESES = {"if", "elseif", "while", "for", "foreach", "switch", "catch", "declare"}
_CODE = re.compile(
    r"""(?P<skip>/\*.*?(?:\*/|\Z)|//[^\n]*?(?=\?>|\n|\Z)|\#(?!\[)[^\n]*?(?=\?>|\n|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))
    |(?P<here><<<[ \t]*["']?(?P<doc>\w+)["']?\n)|(?P<island>\?>.*?(?:<\?php|<\?=|\Z))|(?P<var>\$\w+)|(?P<op>->|\?->|::|=>)|(?P<word>[A-Za-z_\\][\w\\]*)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>;)""",
    re.S | re.X,
)
_OUTSIDE = re.compile(r"\$(_[A-Z]+|argv)\Z")  # variables that the outside fills; only these and their subscripts are spans
_LINE_WORD = re.compile(r"\n[ \t]*(\w+)")  # what may end a heredoc
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", re.S)


def _code_spans(text: str, php: bool) -> tuple[list[tuple[str, int, int]], str | None]:
    spans, at = [], 0
    if php:
        first = re.search(r"<\?(php|=)", text)
        if not first:
            return [], None
        at = first.end()
    stack: list[tuple[str, list, int]] = []  # bracket, what ends with it: (kind, start); where the expression before it began
    declared: list[tuple[str, int]] = []  # declarations whose body hasn't opened
    statement: tuple[str, int] | None = None
    word, word_at, before, classes, problem = "", 0, "", 0, None
    pending: str | None = None
    chain = 0  # where the chain of accesses that is being read began
    named: tuple[int, int] | None = None  # the last variable of the outside, which a subscript may follow at once
    begun: tuple[int, int, str] | None = None  # the statement that is being read: where it began, under how many brackets, its first word
    outer: list[tuple[int, int, str] | None] = []  # by bracket, the statement around it
    ends_of: dict[str, list[tuple[int, int]]] | None = None  # where each word begins a line, for heredocs
    while m := _CODE.search(text, at):
        kind, tok, at = m.lastgroup, m[0], m.end()
        if kind == "doc" or kind == "here":
            if ends_of is None:
                ends_of = {}
                for w in _LINE_WORD.finditer(text):
                    ends_of.setdefault(w[1], []).append(w.span())
            ends = ends_of.get(m["doc"], [])
            i = bisect.bisect_left(ends, (at,))
            if i == len(ends):
                at = m.start() + 3
                continue
            kind, at = "skip", ends[i][1]
        if kind in ("end", "island") and statement:
            spans.append((statement[0], statement[1], m.start() + (kind == "end")))
            statement = None
        if kind == "end" and begun and len(stack) == begun[1]:
            if begun[2] not in STATEMENTS:
                spans.append(("expression_statement", begun[0], m.end()))
            begun = None
        elif kind == "island":
            begun = None
        elif begun is None and kind in ("word", "var") or kind == "open" and begun is None and tok != "{":
            low = tok.lower()
            begun = None if low in LEADS else (m.start(), len(stack), low)
        if kind == "word":
            low = tok.lower()
            if low in INCLUDES or low == "echo":
                statement = (INCLUDES.get(low, "echo_statement"), m.start())
            elif low in ("class", "interface", "trait") and before != "op":
                declared.append(("class_declaration", m.start()))
            elif low == "function":
                declared.append(("method_declaration" if classes else "function_definition", m.start()))
            pending = {"->": "member_call_expression", "?->": "member_call_expression", "::": "scoped_call_expression"}.get(word if before == "op" else "", "function_call_expression")
            if before == "word" and word.lower() == "function":
                pending = None
            chain = chain if before == "op" and word in ("->", "?->", "::") else m.start()
            word, word_at, before = tok, m.start(), "word"
            continue
        named = None if kind == "var" or named and named[1] != m.start() else named
        if kind == "var" and before != "op":
            chain = m.start()
        if kind == "var" and _OUTSIDE.match(tok):
            spans.append(("variable_name", m.start(), m.end()))
            named = m.start(), m.end()
        if kind == "open":
            ends = []
            if tok == "(" and before == "word" and pending and word.lower() not in NOT_CALLS:
                ends.append((pending, chain if pending != "function_call_expression" else word_at))
            if tok == "{" and declared:
                ends.append(declared.pop())
                classes += ends[-1][0] == "class_declaration"
            if tok == "[" and named and named[1] == m.start():
                ends.append(("subscript_expression", named[0]))
            stack.append((tok, ends, chain))
            outer.append(begun)
            begun = None if tok == "{" else begun
        elif kind == "close":
            if not stack or "({[".index(stack[-1][0]) != ")}]".index(tok):
                problem = "SYNTAX_ERROR"
                while stack and "({[".index(stack[-1][0]) != ")}]".index(tok):
                    _, ends, chain = stack.pop()
                    begun = outer.pop()
                    spans += [(k, s, m.start()) for k, s in ends]
            if stack:
                opened, ends, chain = stack.pop()
                begun = outer.pop()
                if begun and len(stack) == begun[1] and (opened == "{" and begun[2] in STATEMENTS or opened == "(" and begun[2] in BEFORE_PARENTHESES):
                    begun = None
                for k, s in ends:
                    spans.append((k, s, m.end()))
                    classes -= k == "class_declaration"
        elif kind == "end" and declared:
            declared.pop()  # an abstract method or a declaration only
        if kind == "op":
            word = tok
        before = kind
    if stack or statement:
        problem = "SYNTAX_ERROR"
        spans += [(k, s, len(text)) for _, ends, _ in stack for k, s in ends] + ([(statement[0], statement[1], len(text))] if statement else [])
    return spans, problem


def _tag_spans(text: str) -> tuple[list[tuple[str, int, int]], str | None]:
    spans, open_ = [], []
    at: dict[str, list[int]] = {}  # places in open_ by name
    for m in _TAG.finditer(text, 0, text.rfind(">") + 1):
        if not m[2]:
            continue
        name = m[2].lower()
        if not m[1]:
            at.setdefault(name, []).append(len(open_))
            open_.append((name, m.start()))
        elif places := at.get(name):
            spans.append(("element", open_[places[-1]][1], m.end()))
            for _ in range(len(open_) - places[-1]):
                at[open_.pop()[0]].pop()
    return spans, None


def spans_of(text: str, language: str, file: str, budget: int = BUDGET) -> tuple[list[tuple], str | None]:
    """Rows (id, kind, label, start and end byte, line and column at both, parent id) in (start, end, kind) order, and a diagnostic."""
    try:
        found, problem = _tag_spans(text) if language == "html" else _code_spans(text, language == "php") if language in ("php", "javascript") else ([], None)
    except (re.error, RecursionError, IndexError, ValueError):
        return [], "PARSE_CRASH"
    tier = {k: i for i, kinds in enumerate(TIERS) for k in kinds}
    found = [x for x in dict.fromkeys(found) if x[2] > x[1]]
    if len(found) > budget:
        found, problem = sorted(found, key=lambda x: (tier.get(x[0], 2), x[1]))[:budget], "IR_BUDGET_EXCEEDED"
    found.sort(key=lambda x: (x[1], x[2], x[0]))
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    bytes_at = _byte_offsets(text, {x for _, s, e in found for x in (s, e)})
    out, around = [], []  # the spans around: end, id if a declaration, else that of the one around it
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        while around and around[-1][0] < e:
            around.pop()
        ident = f"ir:{file}:{bytes_at(s)}:{bytes_at(e)}:{kind}"
        parent = around[-1][1] if around else None
        around.append((e, ident if kind in TIERS[0] else parent))
        ls, le = bisect.bisect_right(starts, s), bisect.bisect_right(starts, e)
        out.append((ident, kind, text[s : min(e, s + 240)], bytes_at(s), bytes_at(e), ls, s - starts[ls - 1], le, e - starts[le - 1], parent))
    return sorted(out, key=lambda r: (r[3], r[4], r[1])), problem


def _byte_offsets(text: str, places: set[int]):
    """Bytes before each of the places in a text."""
    if text.isascii():
        return lambda i: i
    before, last, n = {}, 0, 0
    for i in sorted(places):
        n += len(text[last:i].encode())
        before[i], last = n, i
    return before.__getitem__


def lift(files: DataFrame, budget: int = BUDGET) -> DataFrame:
    """files (file, language, text) to spans, with a row of kind null per diagnostic. Null texts yield nothing.

    Python holds one text and its spans at a time, and ROWS rows at most that wait to be passed on, whatever a batch holds."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int32() if x.split()[1] == "int" else pa.string() for x in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        rows = []
        for b in batches:
            for at in range(b.num_rows):
                file, language, text = (c[at].as_py() for c in b.columns)
                spans, problem = spans_of(text or "", language or "", file or "", budget)
                for i, s in enumerate(spans):
                    rows.append((file, *s, i, None))
                    if len(rows) >= ROWS:
                        yield batch(rows)
                        rows = []
                if problem:
                    rows.append((file, *[None] * 11, problem))
            if rows:
                yield batch(rows)
                rows = []

    return files.select("file", "language", "text").mapInArrow(run, SCHEMA)


def within_budget(spans: DataFrame, budget: int) -> DataFrame:
    """The first spans of each file by line, with status PARTIAL where some are left out."""
    n = F.count("*").over(Window.partitionBy("file"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return spans.withColumns({"_n": n, "_nth": nth}).where(F.col("_nth") <= budget).withColumn("status", F.when(F.col("_n") > budget, "PARTIAL").otherwise("OK")).drop("_n", "_nth")
