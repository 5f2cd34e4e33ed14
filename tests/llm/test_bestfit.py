"""Best-fit decreasing against a scan over all bins, and the packing of documents."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factspark.llm import bestfit

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = [(5, "The cat " * 700), (2, None), (2, ""), (None, "no id"), (None, "no id"), (9, "dog."), (9, "dog."), (-1, "Été # 1"), (7, "one two three four five"), (8, "<|endoftext|> " * 9)]


def scan(sizes, room):
    """What is left in every bin, by the definition."""
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= s
        else:
            left.append(room - s)
    return left


@pytest.mark.parametrize("room", [1, 2, 7, 64, 100])
@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_runs_are_best_fit_decreasing(room, n):
    for seed in range(8):
        rng = random.Random(seed)
        sizes = [rng.randint(1, rng.choice([room, max(1, room // 3)])) for _ in range(n)]
        runs, bins = bestfit.best_fit_decreasing(Counter(sizes), room)
        assert sorted(scan(sizes, room)) == sorted(left_of(runs, Counter(sizes), bins, room))


def left_of(runs, counts, bins, room):
    look, parts = bestfit.seats(runs), {b: [] for b in range(bins)}
    for s, n in counts.items():
        for b, o in zip(*look(np.full(n, s), np.arange(n)), strict=True):
            parts[b].append((o, s))
    for p in parts.values():
        at = 0
        for o, s in sorted(p):
            assert o == at
            at += s
        assert 0 < at <= room
    return [room - sum(s for _, s in p) for p in parts.values()]


def test_many_equal_pieces_are_few_runs():
    runs, bins = bestfit.best_fit_decreasing({1: 10**12, 7: 10**11, 1500: 10**9, 2048: 10**10}, 2048)
    assert len(runs) < 12 and bins >= (10**12 + 7 * 10**11 + 1500 * 10**9 + 2048 * 10**10) // 2048
    runs, _ = bestfit.best_fit_decreasing({s: 1 + s * 7919 % 1000 for s in range(1, 2049)}, 2048)
    assert len(runs) < 60_000


def test_tightest_bin_of_all():
    tree = bestfit.Capacities(100)
    for left in (100, 3, 50, 64, 50):
        tree.put(left, left, 1)
    assert [tree.take(s) and tree.take(s)[0] for s in (4,)] == [50]
    assert tree.take(51)[0] == 64 and tree.take(51)[0] == 100 and tree.take(51) is None and tree.take(1)[0] == 3 and tree.take(1) is None


def check(spark, docs, rows, length):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in docs)
    by_doc, by_sequence, sizes = {}, {}, []
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 4 * length and r.crc == zlib.crc32(r.ids)
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        sizes.append(r.length)
    for (i, ids), n in want.items():
        if sum(k for (j, _), k in want.items() if j == i) > 1 and n == 1:
            continue
        own = sorted(by_doc[i], key=lambda r: r.piece)
        pieces = [ids[max(0, e - length) : e] for e in range(len(ids), 0, -length)][::-1]
        assert [(r.piece, r.start, r.length) for r in own] == [(k, sum(map(len, pieces[:k])), len(p)) for k, p in enumerate(pieces) for _ in range(n)]
        assert b"".join(r.ids for r in own) == b"".join(np.array(p, "<u4").tobytes() for p in pieces for _ in range(n))
    assert sum(sizes) == sum(len(ids) * n for (_, ids), n in want.items())
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(length - sum(n for _, n in p) for p in by_sequence.values()) == sorted(scan(sizes, length))


@pytest.mark.parametrize("length", [1, 16, 64, 2048])
@pytest.mark.parametrize("most", [0, bestfit.BROADCAST_COUNTS])
def test_pack(spark, length, most, monkeypatch):
    monkeypatch.setattr(bestfit, "BROADCAST_COUNTS", most)
    d = spark.createDataFrame([(i, t, "x", 1.0) for i, t in DOCS], "doc_id long, text string, ids string, task double").repartition(3)
    check(spark, DOCS, bestfit.pack(d, PATH, length=length).withColumn("crc", F.crc32("ids")).collect(), length)


def test_pack_many(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["cat", "tree", "Über", "x1"]) for _ in range(rng.randint(0, 90)))) for i in range(500)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(spark, docs, bestfit.pack(d, PATH, length=64).withColumn("crc", F.crc32("ids")).collect(), 64)


def test_no_rows(spark):
    assert bestfit.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no generated tables")
def test_the_query_on_whole_tables(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {}
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    rows = bestfit.op13_best_fit(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used: dict = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(used) == len(scan([n for _, n, _ in want.values()], 2048))
