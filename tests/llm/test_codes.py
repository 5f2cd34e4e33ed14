"""Product codes against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from factspark.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error double"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label) of usable rows, and the codebooks' digest, by exhaustive search over Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    w = dims // parts
    ints = [[math.floor(4096 * x) if abs(x) < 1e100 else 4096 * int(x) for x in v] + [0] * (dims - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))
    books = [[ints[r][p * w : p * w + w] for r in order[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: [min((dist(v[p * w : p * w + w], e), n) for n, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        at = [near(v) for v in ints]
        for p in range(parts):
            for n in range(len(books[p])):
                mine = [v[p * w : p * w + w] for v, a in zip(ints, at, strict=True) if a[p][1] == n]
                if mine:
                    books[p][n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = [near(v) for v in ints]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{n:02x}" for _, n in a), sum(d for d, _ in a), lab) for (i, _, lab), a in zip(kept, at, strict=True)], digest


def compare(spark, rows, **how):
    want, digest = plain(rows, **how)
    df = spark.createDataFrame([(i, v, lab, "x", 1.0) for i, v, lab in rows], SCHEMA).repartition(3)
    got, books = codes.compress(df, **how)
    key = lambda r: repr(r)
    got = got.collect()
    long = lambda e: e if e < 1 << 63 else None
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got), key=key) == sorted(((i, c, long(e), None if lab is None else str(lab)) for i, c, e, lab in want), key=key)
    assert books.sha256() == digest
    sums = {}
    for _, _, e, lab in want:
        sums[None if lab is None else str(lab)] = sums.get(None if lab is None else str(lab), 0) + e
    assert all(r.label_error == long(sums[r.label]) for r in got)


def random_rows(n, dims, seed=1, step=0.01):
    rng = random.Random(seed)
    return [(rng.randrange(n), [round(rng.gauss(0, 1) / step) * step for _ in range(dims)], rng.choice([0, 0, 1, None])) for _ in range(n)]


@pytest.mark.parametrize("dims", [8, 24])
def test_equals_plain_python(spark, dims):
    compare(spark, random_rows(150, dims))


def test_odd_rows(spark):
    rows = random_rows(40, 16, 2, 1.0)  # whole numbers: many ties
    rows += [rows[0]] * 60 + [(None, [1.0] * 16, 1), (None, [0.5] * 16, None), (3, None, 1), (4, [1.0, None] * 8, 1), (5, [float("nan")] * 16, 1), (6, [float("inf")] * 16, 0), (7, [], 1), (8, [2.0] * 5, 0), (-9, [-0.0] * 16, 5)]
    compare(spark, rows)
    compare(spark, rows, parts=3, entries=5, rounds=2)


@pytest.mark.parametrize("big", [1e6, 1e30, -1.7e308])
def test_large_components(spark, big):
    compare(spark, [*random_rows(30, 8, 3), (100, [big] * 8, 2), (101, [big, 0.1] * 4, 2), (102, [-big / 3] * 8, 9)], rounds=3)


def test_few_rows_and_none(spark):
    compare(spark, random_rows(3, 8, 4))
    compare(spark, [(1, [], 1), (2, [], 2)])
    got, books = codes.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert books is None and got.columns == ["vec_id", "label", "code", "error", "label_error"] and got.count() == 0


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    compare(spark, random_rows(80, 8, 5))


def test_codes_decode_to_their_entries(spark):
    got, books = codes.compress(spark.createDataFrame([(i, v, 1) for i, v, _ in random_rows(60, 8, 6)], "vec_id long, embedding array<double>, label int"))
    for r in got.collect():
        decoded = books.decode(r.code)
        assert len(decoded) == 8 and all(decoded[p] == books.entries[p][int(r.code[2 * p : 2 * p + 2], 16)][0] for p in range(8))


@pytest.mark.parametrize("dtype", [np.int64, object])
def test_trees_are_exact_and_skip_entries(dtype):
    rng = np.random.default_rng(7)
    centres = rng.integers(-4000, 4000, (4, 6))
    books = [np.array(centres[rng.integers(0, 4, 64)] + rng.integers(-30, 30, (64, 6)), dtype) for _ in range(3)]
    books[1][5:9] = books[1][0]  # equal entries: the lowest number wins
    x = np.array(centres[rng.integers(0, 4, (200, 3))] + rng.integers(-30, 30, (200, 3, 6)), dtype)
    x[:20, 1] = books[1][7]
    numbers, d, seen = codes.VantageTrees(books).search(x)
    for p in range(3):
        all_ = ((x[:, p][:, None] - books[p][None]) ** 2).sum(2)
        assert (numbers[:, p] == all_.argmin(1)).all() and (d[:, p] == all_.min(1)).all()
    assert (numbers[:20, 1] == 0).all() and seen < 0.7 * 200 * 3 * 64
