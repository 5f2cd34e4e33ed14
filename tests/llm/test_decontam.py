import random
import re

import numpy as np
from pyspark.sql import functions as F

from factspark.llm.decontam import Benchmark, WuManber, find_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        m = min(window, len(b))
        for i in range(len(b) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_search_finds_what_a_loop_finds():
    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 5):
        p = np.unique(rng.integers(1, 4, (6, m)), axis=0)
        w = rng.integers(0, 4, 3000)
        got = set(zip(*(x.tolist() for x in WuManber(p, 4).search(w)), strict=True))
        assert got == {(i, k) for i in range(m - 1, len(w)) for k in range(len(p)) if (w[i - m + 1 : i + 1] == p[k]).all()}


def test_against_brute_force_with_odd_rows(spark):
    rng = random.Random(2)
    vocabulary = ["The", "cat", "É", "x9", "été", "dog", "zu"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 12, 15]))) for i in range(12)] + [(None, text(11)), (3, None), (4, "...")]
    docs = [(i, text(rng.choice([0, 5, 40])) + " " + (rng.choice(items)[1] or "") + " " + text(8), "q") for i in range(60)] + [(60, None, "q"), (61, "", "q"), (None, items[5][1], None), (5, "x " * 5000, "q"), (5, "x " * 5000, "q")]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string, n_words string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(docs)
    known = [(i, t) for i, t in items if i is not None]
    for r in found:
        n, hit, ids = brute(r.text, items)
        assert (r.n_words, sum(s.end - s.start for s in r.hit_spans)) == (n, hit)
        assert r.hit_items == brute(r.text, known)[2]


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    from factspark.llm import decontam

    items = spark.createDataFrame([(i, " ".join(f"w{(i * 3 + j) % 40}" for j in range(14))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 40}" for j in range(30))) for i in range(20)], "doc_id long, text string")
    one = sorted(map(str, find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert sorted(map(str, find_leaks(docs, items).collect())) == one


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, items).first().hit_items == []
    assert find_leaks(docs.where(F.lit(False)), items).count() == 0
    assert Benchmark([]).scan([b"a b c"]) == [(3, [], set())]


def test_half_a_million_windows_leave_positions_to_skip():
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(40_000)]
    items = [(i, " ".join(names[k] for k in rng.integers(0, 40_000, 1_000))) for i in range(510)]
    b = Benchmark(items)
    search = b.searches[0][0]
    assert len(search.patterns) > 500_000 and search.shift.nbytes <= 1 << 27
    # what workers hold: the table, patterns, order and suffixes
    assert search.shift.nbytes + search.patterns.nbytes + search.order.nbytes + search.suffix.nbytes < 200_000_000
    w = rng.integers(1, 40_001, 200_000).astype(np.int32)
    assert search.shift[(search._hash(w, np.arange(9, len(w))) >> search.down).astype(np.int64)].mean() > 6
    text = " ".join(names[k] for k in rng.integers(0, 40_000, 5_000)).encode()
    given = items[77][1].encode()
    (_, none, _), (n, spans, ids) = b.scan([text, text + b" " + given])
    assert none == [] and spans == [(5_000, 6_000)] and ids == {"77"} and n == 6_000
