"""Word-wise encoding, packing and the token file."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factspark.llm import packing, rans
from factspark.llm.tokens import WordEncoder

ODD = ["", " a", "a ", "a  b", "a\n\nb", "\n", "it's 's 12 34x Éá ΑΣ ß", "x  y", "a\tb", "'t d'", "<|endoftext|>", "\x1c a", "日本 語。 12３", "á ́b", "#", "x" * 50_000, "ΑΣ, ΑΣ. Σ", "İ I", "a b", "!!", "don't we'll"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_wise_ids_are_the_librarys(name):
    e = WordEncoder(public_tokenizers.path(name), cache=20)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\tabÉß.,'!1９́ ") for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert e.encode(t) == e.whole(t), t


SPACES = [f"a{c}b" for c in map(chr, range(0x3001)) if c.isspace()] + [f"{a}b" for a in " \n"] + [f"b{a}" for a in " \n"]
MARKED = [f"word{m}" for m in (".", "...", "!!", "###", ",&", "'s.", "_", '."', "()", "-a.", "1.", "é.", ")'t")]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("size", [1, 300, 1 << 23])
def test_ids_of_many_texts_are_the_librarys(name, size):
    e = WordEncoder(public_tokenizers.path(name), cache=50)
    rng = random.Random(2)
    texts = [*ODD, None, *SPACES, *MARKED, *(f"x {m}\n{m} y" for m in MARKED)] + ["\n".join(" ".join(rng.choice(["The", "cat", "é.", "x##", "##", "ßa,"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    want = [e.whole(t or "") for t in texts]
    assert e.encode_each(pa.array(texts, pa.string()), size) == want
    assert e.encode_each(pa.array([None, *texts], pa.string()).slice(1), size) == want
    assert e.encode_each(pa.array(texts, pa.large_string()), size) == want
    assert e.encode_each(pa.array([], pa.string()), size) == [] and e.encode_each(pa.array([None, ""], pa.string()), size) == [b"", b""]


def test_tokens_are_looked_up_once_a_distinct_piece_and_merged_once_a_word(spark, monkeypatch):
    """What tokenize does over many alike texts grows with their distinct words, not with all of them."""
    e = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    looked, merged, get, ids = [], [], type(e.rest).__getitem__, e._ids

    class Counted(type(e.rest)):
        def __getitem__(self, piece):
            looked.append(piece)
            return get(self, piece)

    e._ids = lambda letters: merged.append(letters) or ids(letters)
    e.first, e.rest = Counted(e.first.encode, 1_000), Counted(e.rest.encode, 1_000)
    monkeypatch.setattr(rans, "encoder", lambda path: e)

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    text = "the cat### the cat... the cat"
    run = rans.tokenize(Rows(), "")
    (got,) = run(iter([pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([text] * 500)], ["id", "text"])]))
    assert set(got.column(1).to_pylist()) == {e.whole(text) + (2).to_bytes(2, "little")}
    assert len(looked) < 20 and len(merged) == len(set(merged)) == 5


def test_crc_of_parts():
    data = bytes(range(256)) * 9
    for cut in ([0], [1, 700], [3, 4, 2000]):
        parts = [data[a:b] for a, b in zip([0, *cut], [*cut, len(data)], strict=True)]
        assert rans.crc_of_parts([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(data)


def test_crc_of_many_parts_makes_its_powers_once(monkeypatch):
    done, apply = [], rans._apply
    monkeypatch.setattr(rans, "_apply", lambda m, v: done.append(0) or apply(m, v))
    data = bytes(range(250)) * 1_000
    parts = [data[a : a + 2_500] for a in range(0, len(data), 2_500)]
    assert rans.crc_of_parts([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(data)
    assert len(done) < 3_000


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 20_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint16)
    k, c = np.unique(np.append(ids, [0, 50_001]), return_counts=True)
    t = rans.Table.of_counts(k.astype(np.int64), c)
    assert t.freq.sum() == 1 << rans.SCALE_BITS and (t.freq > 0).all()
    states, words = rans.encode_block(ids, t)
    assert (rans.decode_block(states, words, n, t, t.slots()) == ids).all()
    if len(words) > 8:
        damaged = bytes([words[0] ^ 1]) + words[1:]
        try:
            assert (rans.decode_block(states, damaged, n, t, t.slots()) != ids).any()
        except (ValueError, IndexError):
            pass


def test_one_symbol():
    t = rans.Table.of_counts(np.array([7]), np.array([5]))
    assert (rans.decode_block(*rans.encode_block(np.full(50, 7), t), 50, t, t.slots()) == 7).all()


DOCS = [(5, "The cat " * 700), (2, None), (2, ""), (None, "no id"), (9, "dog."), (9, "dog."), (-1, "Été # 1")]


@pytest.mark.parametrize("block", [1 << 17, 100])
def test_token_file_reads_back(spark, block, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", block)
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = WordEncoder(path)
    tokens = rans.tokenize(spark.createDataFrame(DOCS, "doc_id long, text string"), path)
    table = rans.count_ids(tokens, 2)
    got = sorted(rans.read_index(rans.write_tokens(tokens, table, 2, parts=3), table).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -1, 2, 2, 5, 9, 9]
    at = 0
    want = {(i, zlib.crc32(np.append(np.frombuffer(e.encode(t), "<u2"), 2).astype("<u4").tobytes())) for i, t in DOCS}
    for r in got:
        assert r.start == at and (r.doc_id, r.ids_crc32) in want
        at += r.n_tokens
    none = tokens.where(F.lit(False))
    assert rans.read_index(rans.write_tokens(none, rans.count_ids(none, 2), 2), rans.count_ids(none, 2)).count() == 0


def test_first_fit_decreasing_equals_a_scan():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        room += [100] * (k == len(room))
        want[i] = (k, 100 - room[k])
        room[k] -= sizes[i]
    assert [want[i] for i in range(300)] == list(zip(bins.tolist(), offsets.tolist(), strict=True))


def test_packing_holds_every_id_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    e = WordEncoder(path)
    rows = packing.pack(spark.createDataFrame(DOCS, "doc_id long, text string"), path, length=256, group=3).collect()
    assert sum(r.length for r in rows) == sum(len(e.encode(t)) // 2 + 1 for _, t in DOCS)
    by_sequence: dict = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 1024 and r.start + r.length <= r.doc_tokens
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_pieces_equal_the_librarys_ids_and_groups_stay_small(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = [(i, f"Some words number {i}, and more. " * (300 if i == 3 else i % 7)) for i in range(40)] + [(40, None)]
    d = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, ids string, grp double")
    rows = packing.pack(d, path, length=64, group=8).select("*", F.crc32("ids").alias("crc")).collect()
    for i, t in docs:
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert np.array_equal(np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]), want) and {r.doc_tokens for r in own} == {len(want)}
        assert all(r.crc == zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in own)
    # a long document's full pieces are spread over groups of their own
    full = [r.sequence_id >> 32 for r in rows if r.length == 64]
    assert len(set(full)) > 5 and max(full) < 0 and len(full) == len({r.sequence_id for r in rows if r.length == 64})


def test_rows_alike_in_everything_are_spread_over_groups(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.range(0, 50_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words").alias("text"))
    rows = packing.pack(docs, path)
    groups = [r["count"] for r in rows.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(groups) == 49 and max(groups) < 1.2 * packing.GROUP and sum(groups) == 50_000
