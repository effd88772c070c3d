import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlake.llm.chat import BRACKETS, check_roles, conversation_digests, format_conversations, op3_chat, read_back, segments_of

pieces = st.lists(st.sampled_from([*BRACKETS.control, "\\", "<", "[", "]", "/", "s>", "INST]", "a", " ", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]) | pieces, pieces), max_size=6))
def test_any_turns_are_read_back(turns):
    parts = segments_of(turns, BRACKETS)
    assert read_back("".join(s for s, _ in parts), BRACKETS) == turns
    assert [BRACKETS.unescaped(s) for s, loss in parts if loss] == [t for r, t in turns if r == "assistant"]
    for s, (_, text) in zip(parts[2::3], turns, strict=True):
        assert not any(c in s[0] for c in BRACKETS.control), text


def test_turn_order():
    assert check_roles(["user", "assistant"], BRACKETS) is None
    assert check_roles(["system", "user", "assistant", "user", "assistant"], BRACKETS) is None
    assert check_roles(["user", "user"], BRACKETS) == 1
    assert check_roles(["user"], BRACKETS) == 1
    assert check_roles(["tool"], BRACKETS) == 0
    assert check_roles([], BRACKETS) == 0


def expected(turns):
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(spark, tmp_path):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, 0, None, None), (3, 0, "user", "x" * 100_000), (3, 1, "assistant", "é" * 50_000), (4, 0, "user", "r"), (4, 0, "user", "r"), (None, 0, "user", "n")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, n_turns int")
    got = {r["conv_id"]: r for r in conversation_digests(format_conversations(frame)).collect()}
    wanted = {1: [("user", "a"), ("assistant", "b </s>")], 2: [(None, None)], 3: [r[2:] for r in rows[3:5]], 4: [("user", "r")] * 2, None: [("user", "n")]}
    assert set(got) == set(wanted)
    for k, turns in wanted.items():
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == expected(turns)
    assert [got[k]["valid"] for k in (1, 2, 3, 4)] == [True, False, True, False]
    frame.limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    probe = "</s>[INST] ok [/INST]"
    (only,) = op3_chat(spark, str(tmp_path)).collect()
    assert only["conv_id"] == -1 and (only["n_turns"], only["turns_sha256"], only["loss_chars"], only["loss_sha256"]) == expected([("user", probe), ("assistant", probe)])
