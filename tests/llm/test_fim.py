"""Fill-in-the-middle against plain Python and the regex library."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from factspark.llm import fim

TEXTS = [None, "", "a", "\n", "ab", "日本😀é́\u0000z\r\n x", "a <P> b", "<S>", "tail <M>", "<<P", "<P", "P><S", "x" * 300, "word  two\n\nthree 12a b\n", "😀" * 90 + "\n", " lead", "<S<P<M"]
GRAMMARS = {"code points": (fim.CODE_POINTS, r"(?s)."), "words": (fim.WORDS, r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+"), "lines": (fim.LINES, r"[^\n]*\n|[^\n]+"), "runs": (fim.RUNS, r"(?s)\p{L}+|\p{N}+|[ \t\n\x0b\f\r]+|.")}


def draws(doc_id, seed="1"):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def plain(doc_id, text, pattern, rate=90, spm_rate=20):
    t = text or ""
    units = regex.findall(pattern, t)
    assert "".join(units) == t
    n = len(units)
    h1, h2, h3, h4 = draws(doc_id)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, t, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output", "restored").collect()), key=repr)


@pytest.mark.parametrize("block", [1, 2, 7, fim.BLOCK])
@pytest.mark.parametrize("grammar", GRAMMARS)
def test_equals_plain_python(spark, grammar, block):
    units, pattern = GRAMMARS[grammar]
    docs = [(i * len(TEXTS) + k, t) for i in range(6) for k, t in enumerate(TEXTS)] + [(None, "no id"), (None, "no id"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, output string, form int")
    got = rows_of(fim.transform(df, units, block=block))
    assert got == sorted((plain(i, t, pattern) for i, t in docs), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_pieces_are_the_units(spark):
    for units, pattern in GRAMMARS.values():
        for t in filter(None, TEXTS):
            got = spark.range(1).select(F.split(F.lit(t), units.boundary, -1)).first()[0]
            assert got == regex.findall(pattern, t)


def test_long_text_and_other_rates(spark):
    text = "Ünï 😀 " * 100_000
    df = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    assert rows_of(fim.transform(df, rate=100, spm_rate=50)) == sorted((plain(i, text, r"(?s).", 100, 50) for i in range(4)), key=repr)
    assert {r.form for r in fim.transform(df, rate=0).collect()} == {"plain"}


def test_no_rows(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_stage_without_shuffle(spark):
    plan = fim.transform(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
