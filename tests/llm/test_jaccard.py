import random

import numpy as np
import pytest

from factspark.llm import jaccard
from factspark.llm.jaccard import folded, may_link, near_duplicates, prefix, shingle_sets, shingles, signature, similar_pairs


def brute(rows, percent=75):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        m = min(5, len(w))
        sets.append((i, {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()))
    low = {i: i for i, _ in rows}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                low[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 20, 60, 200]))] for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["new"], [rng.choice(vocabulary), "y"]])
            w = w or ["z"]
        if rng.random() < 0.3:
            w += common
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a"), (n + 4, "A"), (n + 5, "é É"), (n + 6, "é É")]


@pytest.mark.parametrize(("seed", "small"), [(1, {"BLOCK": 16}), (2, {"BLOCK": 4, "HOT_GRADE": 2, "STRETCH": 3_000, "LARGE": 5}), (3, {"ROUNDS": 1, "BLOCK_SHINGLES": 400}), (4, {"OFFER": 0.99, "BROADCAST_ROWS": 0})])
def test_against_brute_force(spark, seed, small, monkeypatch):
    for k, v in small.items():
        monkeypatch.setattr(jaccard, k, v)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_repeated_rows_nulls_and_clashing_columns(spark):
    d = spark.createDataFrame([(7, "a b c d e f", 1), (7, "a b c d e f", 1), (3, "A b c d e f", 2), (None, "a b c d e f", 3)], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(d).collect()), key=str)
    assert got[:3] == [(3, 3), (7, 3), (7, 3)] and len(got) == 4
    assert near_duplicates(d.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none_are_judged_by_their_texts(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (5, "u v w x y z"), (None, "k l m n o p"), (None, "K l m n o p"), (9, None), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (5, 2, 1), (None, 2, None), (None, 2, None), (9, 0, 9), (None, 0, None)], key=repr)


def test_one_large_group_and_one_passage_that_all_share(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    near = [(i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]])) for i in range(300)]
    loose = [(1_000 + i, " ".join([*(f"p{k}" for k in range(30)), *(f"r{rng.random()}" for _ in range(20))])) for i in range(200)]
    long = [(2_000 + i, " ".join([*(f"q{k}" for k in range(9_000)), *(f"{i}s{k}" for k in range(200 * i))])) for i in range(4)]
    rows = near + loose + long
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_all_links(spark):
    rows = corpus(6, 80)
    pairs, membership = similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r.node: r.doc_id for r in membership.collect()}
    of = {i: set(shingles(t).tolist()) for i, t in rows}
    got = {tuple(sorted((texts[r.a], texts[r.b]))) for r in pairs.collect()}
    kept = sorted(texts.values())
    want = {(a, b) for n, a in enumerate(kept) for b in kept[n + 1 :] if 100 * len(of[a] & of[b]) >= 75 * len(of[a] | of[b])}
    assert got == want


def test_prefixes_of_linked_sets_meet_in_any_order():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(30, len(pool)), replace=False)) for _ in range(2))
        common = np.sort(rng.choice(pool, 20, replace=False))
        counts = rng.integers(1, 9, 20)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            assert len(set(prefix(a, common, counts).tolist()) & set(prefix(b, common, counts).tolist())) >= min(jaccard.SHARED, shared)
        s = [np.frombuffer(signature(x), np.uint64)[None] for x in (a, b)]
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            assert may_link(*s, np.array([len(a)]), np.array([len(b)])).all()


def test_signatures_never_rule_out_a_link_of_large_sets():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    b = a[: int(0.8 * len(a))]
    x, y = folded([signature(a), signature(b)])
    assert len(signature(a)) > len(signature(b)) and may_link(x[None], y[None], np.array([len(a)]), np.array([len(b)])).all()


def test_shingles():
    assert len(shingles(None)) == len(shingles(" \t")) == 0
    assert len(shingles("a b")) == 1 and len(shingles("a b c d e f")) == 2 and len(shingles("a a a a a a a a")) == 1
    words = ["x" * n for n in (1, 7, 8, 9, 16, 63, 64, 65, 200)]
    assert len({int(shingles(w)[0]) for w in words}) == len(words) and (shingles(words[-1]) == shingles(words[-1].upper())).all()
    texts = ["a b c d e f g", None, "b c d e f g", " ", "z" * 3_000_000, "a b", "a b c d e f g"]
    assert all((x == shingles(t)).all() for x, t in zip(shingle_sets(texts), texts, strict=True))
    assert (shingles("A B C D E") == shingles("a\nb  c d\te")).all() and len(shingles("a b c d " * 30_000)) == 4
