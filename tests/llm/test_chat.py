from pyspark.sql import functions as F

from mdlake.llm import chat


def render(turns):
    return "".join(f"<|turn:{r or ''}|>\n{(t or '').replace('<|', '< |')}<|end|>\n" for r, t in turns)


def brute(a, b):
    n = 0
    while a is not None and b is not None and n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return (n, render((a or b)[:n]), None if a is None else render(a[n:]), None if b is None else render(b[n:]))


CONVERSATIONS = {
    0: [("system", "be kind"), ("user", "hi"), ("assistant", "hello <|end|> é")],
    1: [("system", "be kind"), ("user", "hi"), ("assistant", "go away"), ("user", "why")],
    2: [("user", "same"), ("assistant", "same")],
    3: [("user", "same"), ("assistant", "same")],
    4: [("user", "alone"), ("assistant", None)],
    7: [(None, ""), ("assistant", "x")],
    8: [("user", "a"), ("user", "a"), ("assistant", "long " * 2000)],
    9: [("user", "a"), ("assistant", "short")],
}


def test_pairs(spark):
    rows = [(c, i * 2, r, t, "x") for c, turns in CONVERSATIONS.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "no", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    pairs = chat.pair_up(chat.turns(table), F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    got = {r["pair_id"]: r for r in chat.preference_rows(pairs).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    for pair, r in got.items():
        plain = [None if t is None else [(x or "", y or "") for x, y in t] for t in (CONVERSATIONS.get(2 * pair), CONVERSATIONS.get(2 * pair + 1))]
        assert (r["n_prompt_turns"], r["prompt"], r["chosen_text"], r["rejected_text"]) == brute(*plain)
        for text, spans in ((r["chosen_text"], r["chosen_spans"]), (r["rejected_text"], r["rejected_spans"])):
            for s in spans or []:
                assert text[s["start"] - 12 : s["start"]] == "assistant|>\n" and text[: s["end"]].endswith("<|end|>\n")
            assert text is None or len(spans) == text.count("<|turn:assistant|>")
    assert got[1]["chosen_text"] == "" and got[2]["rejected_text"] is None


def test_empty(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_rows(chat.pair_up(chat.turns(table), F.col("conv_id"), F.lit(True))).count() == 0
