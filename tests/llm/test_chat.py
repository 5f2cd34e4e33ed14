import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factspark.llm.chat import format_turns, parse, read_back, render_turn

PIECES = st.lists(st.sampled_from(["\\", "###", "### assistant: ", "</turn>", "\n</turn>\n", "#", "</", "turn>", "é", " ", "\n", ":", "x"]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a b", "x:y", "é%"]), PIECES), max_size=4))
def test_round_trip(turns):
    assert parse("".join(render_turn(r, t)[0] for r, t in turns)) == turns


@pytest.mark.parametrize("bad", ["x", "### user: a", "### user: a</turn>", "### user: a\n</turn>", "### user: ### b\n</turn>\n"])
def test_what_is_no_conversation(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_loss_mask_and_digests(spark):
    own = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", own), (1, 0, "user", own), (2, 0, "user", None), (2, 1, None, "a"), (2, 2, "assistant", ""), (None, 0, "assistant", "x"), (3, 0, "assistant", "é" * 50_000), (3, 0, "assistant", "é" * 50_000)]
    out = {r.conv_id: r for r in read_back(format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert out[1].loss_chars == len(own) and out[1].loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
    assert out[1].turns_sha256 == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()
    assert out[2].n_turns == 3 and out[2].loss_chars == 0 and out[3].n_turns == 2 and out[3].loss_chars == 100_000 and out[None].n_turns == 1
    assert read_back(format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
