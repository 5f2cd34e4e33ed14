"""The lexer's work grows with the text, and what it skips; nesting by a sweep."""

import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest

from factspark.operators import lift, nesting
from factspark.operators.lift import spans_of

LONG = {
    "calls": ("php", lambda n: "<?php " + "f(" * (n // 2)),
    "tags": ("html", lambda n: "<p>" * (n // 7) + "</b>" * (n // 7)),
    "nested tags": ("html", lambda n: "<p>" * (n // 7) + "</p>" * (n // 7)),
    "open tags": ("html", lambda n: "<a " * (n // 3)),
    "comments": ("html", lambda n: "<!-- <a>" * (n // 8)),
    "heredocs": ("php", lambda n: "<?php " + "<<<EOT\n" * (n // 7)),
    "heredocs of many names": ("php", lambda n: "<?php " + "".join(f"<<<E{i}\n" for i in range(n // 9))),
    "functions": ("javascript", lambda n: "function a(){" * (n // 13)),
    "closers": ("php", lambda n: "<?php " + "(" * (n // 2) + "}" * (n // 2)),
    "quotes": ("php", lambda n: "<?php " + "\"'" * (n // 2)),
}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_takes_seconds(name):
    language, make = LONG[name]
    spans_of(make(1_000), language, "f")
    began = time.process_time()
    spans_of(make(1_000_000), language, "f")
    assert time.process_time() - began < 20


@pytest.mark.parametrize("seed", range(40))
def test_heredocs_end_where_a_search_to_the_end_says(seed):
    rng = random.Random(seed)
    text = "<?php " + "".join(rng.choice(["<<<A\n", "<<<'B'\n", '<<< "A"\n', "\nA", "\n  A;", "\nAB", "\nB\n", "f(1);\n", "x", "\n", "<<<", "'q' "]) for _ in range(30))
    here = re.compile(r"<<<[ \t]*[\"']?(?P<doc>\w+)[\"']?\n.*?\n[ \t]*(?P=doc)\b", re.S)
    quoted = re.compile(r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)", re.S)
    at, blank = 6, list(text)
    while at < len(text):  # blank out what is skipped, by the definition
        m = here.match(text, at) or quoted.match(text, at)
        if m:
            blank[m.start() : m.end()] = [c if c == "\n" else " " for c in m[0]]
        at = m.end() if m else at + 1
    calls = lambda t: [(r[3], r[4]) for r in spans_of(t, "php", "f")[0] if r[1] == "function_call_expression"]
    assert calls(text) == calls("".join(blank))


def test_parents_are_the_declarations_around():
    text = "<?php class A { function b() { c(d()); } } function e() { f(); } g();"
    rows = {r[2][:12]: r for r in spans_of(text, "php", "x")[0] if r[1] != "expression_statement"}
    assert rows["class A { fu"][-1] is None and rows["function e()"][-1] is None and rows["g()"][-1] is None
    method = rows["function b()"]
    assert method[-1] == rows["class A { fu"][0] and rows["c(d())"][-1] == rows["d()"][-1] == method[0] and rows["f()"][-1] == rows["function e()"][0]


SPANS = "file string, id string, start long, `end` long, kind string"


def smallest(rows, inner, outer):
    """By looking at all pairs."""
    out = []
    for f, i, s, e, k in rows:
        around = [(oe - os, os, o) for g, o, os, oe, ok in rows if g == f and ok == outer and k == inner and os <= s and oe >= e and o != i]
        if around:
            out.append((f, i, min(around)[2]))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 7, 40, nesting.CHUNK])
@pytest.mark.parametrize("kinds", [("a", "b"), ("a", "a")])
def test_the_smallest_span_around(spark, chunk, kinds):
    rng = random.Random(chunk)
    rows = []
    for n in range(300):
        s = rng.randrange(60)
        rows.append((f"f{rng.randrange(3)}", f"{n:03d}", s, s + rng.choice([0, 1, 3, 9, 30]), rng.choice("aab")))
    rows += [("one", f"k{i}", 5, 9, "a") for i in range(3)]
    got = nesting.enclosing(spark.createDataFrame(rows, SPANS).repartition(4), *kinds, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == smallest(rows, *kinds)


def test_a_hot_file_is_cut_and_swept_in_linear_time(spark):
    n = 60_000
    deep = [("f", f"o{i:06d}", i, 4 * n - i, "b") for i in range(n)]
    flat = [("f", f"i{i:06d}", n + i, n + i + 1, "a") for i in range(n)]
    began = time.time()
    got = nesting.enclosing(spark.createDataFrame(deep + flat, SPANS), "a", "b", chunk=50_000)
    assert got.count() == n and got.where(f"outer <> 'o{n - 1:06d}'").count() == 0
    assert time.time() - began < 120


def test_no_spans(spark):
    assert nesting.enclosing(spark.createDataFrame([], SPANS), "a", "b").count() == 0


class Rows:
    """In place of a table: what lift gives to mapInArrow."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


@pytest.mark.parametrize(("language", "text"), [("html", "<p><b>é</b></p>\n" * 20), ("php", "<?php\n" + "f($_GET['é']);\n" * 10)])
def test_lift_passes_rows_on_before_a_batch_is_read_to_its_end(language, text):
    n, each = 2_000, len(spans_of(text, language, "f")[0])
    rows = pa.RecordBatch.from_pydict({"file": [f"f{i}" for i in range(n)], "language": [language] * n, "text": [text] * n})
    run = lift.lift(Rows())
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in run(iter([rows]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == n * each and each >= 30 and max(sizes) <= lift.ROWS
    assert peak < 8e6
    whole = pa.Table.from_batches(run(iter([rows.slice(0, 200)])))
    want = [(f"f{i}", *s, k, None) for i in range(200) for k, s in enumerate(spans_of(text, language, f"f{i}")[0])]
    assert [tuple(r.values()) for r in whole.to_pylist()] == want


def test_lift_of_a_text_beyond_one_batch_of_rows_and_of_nothing():
    run = lift.lift(Rows())
    n = lift.ROWS + 1
    rows = pa.RecordBatch.from_pydict({"file": ["a", "b", "c"], "language": ["php", "php", None], "text": ["<?php " + "f();" * lift.ROWS + "g(", None, None]})
    got = pa.Table.from_batches(run(iter([rows]))).to_pylist()
    assert [r["ord"] for r in got if r["kind"] == "function_call_expression"] == sorted(r["ord"] for r in got if r["kind"] == "function_call_expression") and sum(r["kind"] == "function_call_expression" for r in got) == n
    assert [(r["file"], r["kind"], r["diagnostic"]) for r in got[-1:]] == [("a", None, "SYNTAX_ERROR")]
    assert not list(run(iter([rows.slice(1)])))


def test_bytes_of_a_long_text_cost_no_list_of_its_length():
    text = "é" * 1_000_000 + "<p>ü\n</p>"
    tracemalloc.start()
    try:
        ((_, _, _, start, end, *_),) = spans_of(text, "html", "f")[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (start, end) == (2_000_000, 2_000_010) and peak < 12e6
