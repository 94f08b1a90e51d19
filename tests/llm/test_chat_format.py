"""Preference formatting: rendering, masks, pairs and their edges."""

import random

from stratalith.llm import chat_format


def test_chat_edges(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    rows = [(1, t(("user", "q"), ("assistant", "a")), t(("user", "q"), ("assistant", "b"))), (2, None, None), (3, t(("user", None)), t(("user", None))), (4, t(("system", "s")), []), (1, t(("user", "x" * 300_000)), t(("assistant", "é")))]
    kind = "array<struct<role:string,text:string>>"
    got = chat_format.format_preferences(spark.createDataFrame([(*r, "p") for r in rows], f"pair_id long, chosen {kind}, rejected {kind}, prompt string")).collect()
    by = {(r.pair_id, r.n_prompt_turns): r for r in got}
    r = by[1, 1]
    assert r.prompt == "<|user|>\nq<|end|>\n" and r.chosen_completion == "<|assistant|>\na<|end|>\n"
    assert [r.chosen_completion[m.start : m.end] for m in r.chosen_mask] == ["a<|end|>"] and [r.rejected_completion[m.start : m.end] for m in r.rejected_mask] == ["b<|end|>"]
    assert by[2, 0].prompt == by[2, 0].chosen_completion == "" and by[3, 1].chosen_completion == "" and by[4, 0].rejected_completion == ""
    r = by[1, 0]
    assert [r.rejected_completion[m.start : m.end] for m in r.rejected_mask] == ["é<|end|>"]
    conv = spark.createDataFrame([(0, 1, "assistant", "a"), (0, 0, "user", "u"), (1, 0, "assistant", "b"), (2, 0, "user", "only"), (None, 0, "user", "lost"), (5, 0, "user", "odd")], "conv_id long, turn long, role string, text string")
    p = {r.pair_id: ([x.text for x in r.chosen], [x.text for x in r.rejected]) for r in chat_format.pairs_from_conversations(conv).collect()}
    assert p == {0: (["u", "a"], ["u", "b"]), 1: (["only"], ["only"])}


def test_empty_tables_and_large_ids(spark):
    kind = "array<struct<role:string,text:string>>"
    assert chat_format.format_preferences(spark.createDataFrame([], f"pair_id long, chosen {kind}, rejected {kind}")).collect() == []
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.pairs_from_conversations(conv).collect() == []
    big = 2**54  # neighbours of this size are one and the same double
    rows = [(big + k, 0, "assistant", str(k)) for k in range(4)] + [(-2, 0, "assistant", "a"), (-1, 0, "assistant", "b")]
    got = {r.pair_id: [x.text for x in r.rejected] for r in chat_format.pairs_from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {big // 2: ["1"], big // 2 + 1: ["3"], -1: ["b"]}


def slow(chosen, rejected):
    show = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def spans(turns):
        at, out = 0, []
        for r, t in turns:
            head, body = len(f"<|{r}|>\n"), len(t + "<|end|>")
            if r == "assistant":
                out.append((at + head, at + head + body))
            at += head + body + 1
        return out

    return n, show(chosen[:n]), show(chosen[n:]), spans(chosen[n:]), show(rejected[n:]), spans(rejected[n:])


def test_against_brute_force(spark):
    rnd = random.Random(7)
    turn = lambda: (rnd.choice(["user", "assistant", "system"]), rnd.choice(["", "a", "né", "long " * 40, "日本"]))
    pairs = []
    for i in range(150):
        head = [turn() for _ in range(rnd.randint(0, 4))]
        pairs.append((i, head + [turn() for _ in range(rnd.randint(0, 3))], head + [turn() for _ in range(rnd.randint(0, 3))]))
    kind = "array<struct<role:string,text:string>>"
    for r in chat_format.format_preferences(spark.createDataFrame(pairs, f"pair_id long, chosen {kind}, rejected {kind}")).collect():
        _, c, j = pairs[r.pair_id]
        got = (r.n_prompt_turns, r.prompt, r.chosen_completion, [tuple(s) for s in r.chosen_mask], r.rejected_completion, [tuple(s) for s in r.rejected_mask])
        assert got == slow(c, j)
