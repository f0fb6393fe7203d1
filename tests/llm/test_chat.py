import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ranktide.llm import chat

NASTY = st.lists(st.sampled_from(["\\", "### User:", "### Assistant:", "</turn>", "\n", "a", " ", "### Role x:", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "odd role:\n", ""]), NASTY), max_size=4))
def test_round_trip(turns):
    parts = [chat.render_turn(r, t) for r, t in turns]
    found = chat.parse("".join(p[0] for p in parts))
    assert [(r, t) for r, t, _, _ in found] == turns


def test_plain_text_is_not_escaped():
    assert chat.render_turn("user", "a \\ b")[0] == "### User:\na \\ b\n</turn>\n"


def test_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>"), (1, 2, "assistant", None), (2, None, None, ""),
            (1, 1, "assistant", "</turn>"), (None, 0, "user", "x" * 70000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 as rendered", "2 as text_start")
    got = {r.conv_id: r for r in chat.read_back(chat.render(df)).collect()}
    turns = [("user", "hi"), ("assistant", "</turn>"), ("assistant", "</turn>"), ("assistant", "")]
    sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (4, sha, 14)
    assert got[1].loss_sha256 == hashlib.sha256(b"</turn></turn>").hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1
    assert chat.read_back(chat.render(df.limit(0))).collect() == []
