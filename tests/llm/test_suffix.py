import random

import numpy as np
import pytest

from factspark.llm import suffix
from factspark.llm.sais import repeated_windows, suffix_array
from factspark.llm.suffix import kept_bytes, removed, stretches


@pytest.mark.parametrize(("n", "k"), [(1, 1), (2, 1), (3, 2), (40, 1), (200, 2), (3000, 3), (4000, 26)])
def test_suffix_array(n, k):
    rng = random.Random(n)
    d = bytes(rng.randrange(97, 97 + k) for _ in range(n))
    d += d[: n // 2]
    assert suffix_array(d).tolist() == sorted(range(len(d)), key=lambda i: d[i:])


def test_repeated_windows_against_a_count():
    rng = random.Random(5)
    contents = [bytes(rng.randrange(97, 99) for _ in range(rng.randrange(8, 60))) for _ in range(30)]
    weights = [rng.choice([1, 1, 2]) for _ in contents]
    seen: dict = {}
    for c, w in zip(contents, weights, strict=True):
        for i in range(len(c) - 7):
            seen[c[i : i + 8]] = seen.get(c[i : i + 8], 0) + w
    for c, m in zip(contents, repeated_windows(contents, weights, 8), strict=True):
        assert [bool(x) for x in m] == [i + 8 <= len(c) and seen[c[i : i + 8]] > 1 for i in range(len(c))]


def brute(rows, width=200):
    seen: dict = {}
    for _, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - width + 1):
            seen[b[j : j + width]] = seen.get(b[j : j + width], 0) + 1
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        on = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - width + 1):
            if seen[b[j : j + width]] > 1:
                on[j : j + width] = True
        e = np.diff(on.astype(int), prepend=0)
        out[i] = list(zip(np.flatnonzero(e == 1).tolist(), np.flatnonzero(e == -1).tolist(), strict=True))
    return out


@pytest.mark.parametrize("hot", [2000, 5])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(hot)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    core, other = text(330), text(240)
    rows = [(i, text(rng.randrange(300)) + rng.choice([core, core[:220], other, "", core + other]) + text(rng.randrange(300))) for i in range(60)]
    rows += [(60, "abc" * 300), (61, "a" * 700), (62, None), (63, ""), (64, "é" * 250), (65, "é" * 99), (66, "same " * 60), (67, "same " * 60), (68, "tiny"), (69, "tiny"), (70, text(150) + "same " * 60)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed_spans string").repartition(5)
    got = {r.doc_id: [(s.start, s.end) for s in r.removed_spans] for r in removed(d).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(300))
    d = spark.createDataFrame([(1, t), (1, t), (2, "short")], "doc_id long, text string")
    got = [(r.doc_id, [(s.start, s.end) for s in r.removed_spans]) for r in removed(d).collect()]
    assert sorted(got) == [(1, [(0, 300)]), (1, [(0, 300)]), (2, [])]
    assert removed(d.limit(0)).count() == 0


def test_rows_with_null_or_repeated_ids_are_judged_like_all_others(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, own, third = text(260), text(250), text(300)
    texts = [text(90) + core, core + text(70), text(40) + own + "-" + own, text(400), third, third, text(50) + core[:230], "short", None]
    ids = [1, None, None, 7, None, None, 7, None, None]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    want = brute(list(enumerate(texts)))
    got = sorted(((r.doc_id, r.text, [(s.start, s.end) for s in r.removed_spans]) for r in removed(d).collect()), key=repr)
    assert got == sorted(((i, t, want[k]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))), key=repr)
    assert removed(d).columns == ["doc_id", "text", "removed_spans"]


def test_stretches_cover_every_window_once():
    rng = random.Random(9)
    data = bytes(rng.randrange(97, 123) for _ in range(5000)) + b"x" * 5000
    parts = stretches(data)
    assert sorted(i for s, n, _, _ in parts for i in range(s, s + n)) == list(range(len(data) - 199))


def test_very_long_text_spans_chunks():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, (1 << 20) + 5000).astype(np.uint8).tobytes()
    parts = stretches(data)
    assert sum(n for _, n, _, _ in parts) == len(data) - 199
    at = {s: (n, a) for s, n, a, _ in parts}
    assert len(at) == len(parts)


def test_kept_bytes():
    assert kept_bytes(b"abcdef", [{"start": 1, "end": 3}, {"start": 5, "end": 6}]) == b"ade"
