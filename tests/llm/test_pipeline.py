"""The pipeline's stages against plain Python, and the queries of the subpackage against their SQL."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from factspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no generated tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        out.append((name, docs))
    return spark.read.parquet(f"{SF}/documents.parquet"), out


def test_columns_and_names(stages):
    assert [n for n, _ in stages[1]] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]
    assert all(d.columns == COLUMNS for _, d in stages[1][:-1])


def test_each_stage_on_its_own_input(stages):
    from test_decontam import brute as leaks
    from test_jaccard import brute as groups
    from test_suffix import brute as spans

    given, out = stages
    rows = [{r.doc_id: r for r in d.collect()} for d in (given, *(d for _, d in out[:4]))]
    assert len(rows[1]) >= 0.97 * len(rows[0])
    group = groups([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i, (_, low) in group.items() if low == i}
    cut = spans([(i, r.text) for i, r in rows[2].items()])
    for i, r in rows[2].items():
        data, left, at = r.text.encode(), b"", 0
        for s, e in cut[i]:
            left, at = left + data[at:s], e
        want = (left + data[at:]).decode(errors="ignore")
        assert (rows[3][i].text == want and rows[3][i].n_chars == len(want)) if i in rows[3] else (cut[i] and not want.strip())
    items = [(r[0], r[1]) for r in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert windows and set(rows[4]) == {i for i, r in rows[3].items() if not leaks(r.text, items)[1]}


def test_near_duplicates_judges_rows_with_one_id_or_none_apart(spark):
    a, b, c, e = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white", "x y z u v w")
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (None, c), (None, e), (None, e), (4, ""), (4, ""), (5, ""), (None, None), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (3, c), (None, e), (4, ""), (5, ""), (None, None), (None, None)], key=repr)


def test_stages_keep_odd_rows_and_columns(spark):
    long = "a passage that comes again and again in these documents " * 6
    rows = [(1, "the dog and the cat " * 20, "en", "s", 1, "mine", "p", 2.0), (1, "the dog and the cat " * 20, "en", "s", 1, "mine", "p", 2.0), (2, None, None, None, None, None, None, None), (None, "", "en", None, 0, "x", "q", 1.0), (3, "une phrase " + long, "fr", "s", 5, "y", None, 0.0), (4, long + "another end", None, "s", 5, None, "z", None)]
    names = "doc_id long, text string, lang string, source string, n_chars int, removed_spans string, hit_items string, lang_pred double"
    d = spark.createDataFrame(rows, names)
    for docs in (d, d.drop("n_chars"), d.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert [t for c, t in out.dtypes if c != "n_chars"] == [t for c, t in docs.dtypes if c != "n_chars"], name
            assert out.count() <= docs.count()
        assert corpus_pipeline.pack(spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    kept = {r.doc_id: r for r in corpus_pipeline.suffix_array_dedup(spark, d, SF).collect()}
    assert kept[3].text.startswith("une phrase") and kept[3].removed_spans == "y" and kept[3].n_chars == len(kept[3].text) and kept[2].text is None


def test_packing_takes_all(stages):
    last = stages[1][-1][1].collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in stages[1][-2][1].collect()}
    assert all(len(r.ids) == 4 * r.length for r in last)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    r = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    order = [df.columns.index(c) for c in names]
    assert sorted((tuple(x[i] for i in order) for x in map(tuple, df.collect())), key=repr) == sorted(r.fetchall(), key=repr)


def test_a_run_leaves_only_its_result(spark, tmp_path, stages, monkeypatch):
    from factspark.llm import _common

    monkeypatch.setattr(_common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    got = corpus_pipeline.run(spark, SF)
    assert [p.name.split("-")[0] for p in (tmp_path / "shared").iterdir()] == ["packing"]
    want = stages[1][-1][1]
    assert sorted((r.doc_id, r.start, r.length, r.ids) for r in got.collect()) == sorted((r.doc_id, r.start, r.length, r.ids) for r in want.collect())
