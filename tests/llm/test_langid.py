import os
import random

import pytest
from pyspark.sql import functions as F

from factspark.llm.langid import Classifier, fit, held_out, identify, op10_language_id

SF = "/root/testdata/sf0.01"


def model(spark):
    words = {"en": "the of and to in that it is was for on are with as".split(), "de": "der die und in den von zu das mit sich des auf ist im".split()}
    rows = [(i, lang, " ".join(words[lang][(i * k + k) % 14] for k in range(40))) for i in range(60) for lang in words]
    return fit(spark.createDataFrame([*rows, (900, None, "x"), (901, "en", None)], "doc_id long, lang string, text string"))


def test_odd_texts(spark):
    m = model(spark)
    assert set(m) == {"de", "en"}
    d = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !!", "q"), (4, "the of and that with", "q"), (5, "der die und mit sich " * 20_000, "q"), (5, "der die und mit sich", "q"), (None, "the is was", "q")], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.lang_rejected) for r in identify(d, m).collect()]
    assert [x[1] for x in got] == ["und", "und", "und", "en", "de", "de", "en"] and [x[2] for x in got[:3]] == [True] * 3
    assert all(0 <= r.lang_score <= 1 for r in identify(d, m).collect())
    assert identify(d.limit(0), m).count() == 0
    assert Classifier({}).predict("x")[0] == "und"
    # fractions, powers and Roman numerals are no letters
    assert Classifier(m).predict("½ ² Ⅷ 1")[:1] + Classifier(m).predict("½")[2:] == ("und", True)


def test_letters():
    from factspark.llm.langid import _words

    assert _words("It's 3½ CMⅧ été x²y_z") == "it s cm été x y z".encode()
    odd = "".join(map(chr, [*range(0x250), *range(0x2070, 0x2190), *range(0x3000, 0x3100)])).lower()
    assert "".join(_words(odd).decode().split()) == "".join(c for c in odd if c.isalpha())


def test_all_parts_of_texts_are_learned_from(spark):
    head = "kopf " * 200
    rows = [("a", head + " ".join(f"mitte{i}x{k}" for k in range(200))) for i in range(40)]
    found = fit(spark.createDataFrame(rows, "lang string, text string"))["a"].decode()
    assert "mittex" not in found and sum("mitte" in w for w in found.split()) > 1_000


def test_no_labels(spark):
    assert fit(spark.createDataFrame([], "doc_id long, lang string, text string")) == {}


def labelled(n):
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(400)] for lang, letters in {"aa": "abcdefgh", "bb": "abcdefij", "cc": "abcdefkl", "dd": "abcdefmn"}.items()}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(60))
    return [(lang, text(lang)) for lang in words for _ in range(n)], [(lang, text(lang)) for lang in words for _ in range(20)]


def test_a_tiny_label_leaves_the_others_as_they_are(spark):
    train, asked = labelled(100)
    without = fit(spark.createDataFrame(train, "lang string, text string"))
    found = fit(spark.createDataFrame([*train, ("xx", "quirk")], "lang string, text string"))
    assert {k: found[k] for k in without} == without and min(map(len, without.values())) > 20_000
    c, d = Classifier(found), Classifier(without)
    assert [c.predict(t)[0] for _, t in asked] == [lang for lang, _ in asked] == [d.predict(t)[0] for _, t in asked]
    # a label without a letter wins nothing
    odd = Classifier(fit(spark.createDataFrame([*train, ("yy", "12"), ("zz", "")], "lang string, text string")))
    assert [odd.predict(t)[0] for _, t in asked] == [lang for lang, _ in asked]


def test_copies_take_no_place_in_the_sample(spark):
    train, _ = labelled(100)
    once = fit(spark.createDataFrame(train, "lang string, text string"))
    copied = spark.createDataFrame([r for r in train for _ in range(80)], "lang string, text string")
    assert fit(copied) == once


@pytest.mark.skipif(not os.path.isdir(SF), reason="no generated tables")
def test_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op10_language_id(spark, SF).join(lang, "doc_id").where("held_out and lang is not null").select((F.col("lang_pred") == F.col("lang")).alias("ok"), "rejected").collect()
    assert len(got) > 200 and sum(r.ok for r in got) / len(got) >= 0.97 and sum(r.rejected for r in got) / len(got) <= 0.02


def test_fold(spark):
    import zlib

    rows = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no generated tables")
def test_rows_are_those_of_a_plain_version(spark):
    import re
    import zlib

    import zstandard

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("text")).collect()]
    learned: dict = {}
    for i, t, lang, h in docs:
        if t is not None and lang is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(lang, {})[h] = t
    letters = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) if not re.fullmatch(r"[\x00-\x7f]*", t) else " ".join(re.findall("[a-z]+", t.lower()))
    packers = {}
    for lang in sorted(learned):
        texts = learned[lang]
        top = min(2**64 - 1, 2**64 * 2 * 200_000 // sum(len(t.encode()) for t in texts.values())) - 2**63
        d = b" ".join(w for h in sorted(texts) if h <= top and (w := letters(texts[h]).encode()))[:200_000]
        packers[lang] = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)

    def plain(t):
        data = letters(t or "").encode()
        if not data:
            return "und"
        if len(data) < 256:
            data = (data + b" ") * (256 // (len(data) + 1) + 1)
        return min((sum(len(p.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)), lang) for lang, p in packers.items())[1]

    got = {r.doc_id: (r.held_out, r.lang_pred) for r in op10_language_id(spark, SF).collect()}
    assert got == {i: (zlib.crc32(str(i).encode()) % 4 == 2, plain(t)) for i, t, _, _ in docs}
