import numpy as np
import pytest

from factspark.llm import embeddings
from factspark.llm.embeddings import Quantiser, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def data(n=900, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(0, n, 4):
        x[i + 1] = x[i] + rng.normal(size=dims) * rng.choice([0.02, 0.1, 0.2, 0.3]) * np.linalg.norm(x[i]) / np.sqrt(dims)
    x[400:460] = x[7] + rng.normal(size=(60, dims)) * 0.01
    x[500:520] = x[500]
    x = x.astype(np.float32)
    return [(i, v, int(i // 4 % 3) if i < 400 or i >= 520 else 1, "?") for i, v in enumerate(x.tolist())]


def brute(rows, least=0.98):
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= least) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    low = np.arange(len(rows))
    while True:
        new = np.minimum(low, np.where(link, low[None], len(rows)).min(1))
        if (new == low).all():
            return link.sum(1), low
        low = new


@pytest.mark.parametrize("block", [1024, 32])
def test_recall_and_precision_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = data()
    links, low = brute(rows)
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = np.array([got[i].n_links for i in range(len(rows))])
    assert (n <= links).all() and n.sum() >= 0.98 * links.sum()
    if (n == links).all():
        assert [got[i].component_id for i in range(len(rows))] == low.tolist()
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0], 1), (11, [1.0, 0.0], 1)]
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == [(0, 3), (1, 3), *((i, 0) for i in range(2, 11)), (11, 3), (11, 3)]
    assert {r.component_id for r in got if r.n_links} == {0}
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0


def test_rows_that_share_an_id_or_have_none_are_judged_by_their_vectors(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (5, [1.0, 0.02], 1), (5, [0.0, 1.0], 1), (None, [-1.0, 0.0], 1), (None, [-1.0, 0.01], 1)]
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted([(None, 2, 5, False), (None, 2, 5, False), (5, 2, 5, True), (5, 0, 5, True), (None, 1, None, False), (None, 1, None, False)], key=repr)


@pytest.mark.parametrize("lists", [1_024, 4_096])
def test_recall_at_many_lists(lists):
    """Every hundredth vector against all rows, by the lists that both are entered in; pairs at the very edge of a link."""
    rng = np.random.default_rng(lists)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(600, 32)))
    x = unit(centres[rng.integers(0, 600, 60_000)] + 0.7 * rng.normal(size=(60_000, 32)) / np.sqrt(32))
    at = np.arange(0, 60_000, 100)
    for i in at:
        off = rng.normal(size=32)
        off -= off @ x[i] * x[i]
        cosine = rng.uniform(0.98, 0.99)
        x[i + 1] = cosine * x[i] + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off)
    coarse = embeddings.kmeans(x[rng.choice(60_000, embeddings.sample_size(lists), replace=False)], lists, 4)
    entered = embeddings.nearest(x, coarse, embeddings.probes(lists))
    truth = [np.setdiff1d(np.flatnonzero(x @ x[i] >= 0.98), [i]) for i in at]
    found = sum(len(np.intersect1d(entered[i], entered[j])) > 0 for i, js in zip(at, truth, strict=True) for j in js)
    assert sum(map(len, truth)) >= len(at) and found >= 0.97 * sum(map(len, truth))


def test_asymmetric_distances_are_within_the_codes_error():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    q = Quantiser(x, 8)
    codes, error = q.code(x[:50])
    exact = np.sqrt(((x[100:130, None] - x[None, :50]) ** 2).sum(2))
    near = np.sqrt(np.maximum(q.distances(x[100:130], codes), 0))
    assert (np.abs(near - exact) <= error[None] + 1e-6).all()
