import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from strandline.llm.chat import Template, escape, format_chats, read_back, unescape

T = Template()


@given(st.lists(st.sampled_from([*T.controls, "\\", "<", "[", "/", "s>", "x", "é", "\n"]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control(text):
    safe = escape(text, T.control)
    assert not T.control.search(safe) and unescape(safe) == text


def test_round_trip(spark):
    rng = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool[INST]", "", None]), rng.choice([None, "", "ok", "a\\b</s>[INST] [/INST]", "x" * 5000])))
    rows += [(None, 0, "user", "hello"), (None, 0, "user", "hello"), (77, None, "user", "q"), (77, 1, "assistant", "a" * 100_000), (78, 0, "user", "q"), (78, 1, "assistant", "[/END]")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string").repartition(7)
    found = {r["conv_id"]: r for r in read_back(format_chats(df)).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert found.keys() == convs.keys()
    for c, own in convs.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert found[c]["n_turns"] == len(own)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[78]["valid"] and not found[None]["valid"]


def test_faults(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    faults = [r["fault"] for r in format_chats(df).collect() if r["fault"]]
    assert faults == ["assistant may not follow start", "may not end with user"]
    assert read_back(format_chats(df.limit(0))).count() == 0
