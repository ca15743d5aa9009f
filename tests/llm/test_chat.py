from boardstat.llm import chat

SCHEMA = "pair_id long, turn long, role string, text string, cut long, chosen string"


def sides(spark, good, bad):
    def frame(rows):
        return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)

    return frame(good), frame(bad)


def conversation(pair, *turns):
    return [(pair, i, role, text) for i, (role, text) in enumerate(turns)]


def test_common_prefix_is_the_prompt(spark):
    start = [("system", "be kind"), ("user", "hello"), ("assistant", "hi"), ("user", "and?")]
    good = conversation(1, *start, ("assistant", "fine"), ("user", "ok")) + conversation(2, ("user", "a")) + conversation(
        3, ("user", "same"), ("assistant", "same")) + conversation(4, ("user", "alone"))
    bad = conversation(1, *start, ("assistant", "bad")) + conversation(2, ("assistant", "b")) + conversation(
        3, ("user", "same"), ("assistant", "same"))
    good += [(None, 0, "user", "x"), (1, None, "user", "x"), good[1], (5, 0, None, None), (5, 3, "assistant", "long " * 50_000)]
    bad += [(5, 0, "user", ""), (5, 3, "assistant", None)]
    turns = chat.preference_turns(*sides(spark, good, bad))
    rows = {(r["pair_id"], r["part"], r["turn"]): r for r in turns.collect()}
    assert len(rows) == turns.count()
    assert [k[2] for k in sorted(rows) if k[:2] == (1, "prompt")] == [0, 1, 2, 3]
    assert [k for k in sorted(rows) if k[0] == 1 and k[1] != "prompt"] == [(1, "chosen", 4), (1, "chosen", 5), (1, "rejected", 4)]
    assert not {3, 4} & {k[0] for k in rows}
    for (_, part, _), r in rows.items():
        trained = r["rendered"][r["train_from"]:r["train_to"]]
        said = part != "prompt" and r["role"] == "assistant"
        assert r["rendered"] == f"<|{r['role']}|>\n" + (trained if said else r["rendered"].split("\n", 1)[1][:-1]) + "\n"
        assert said or (r["train_from"], r["train_to"]) == (0, 0)
    whole = {r["pair_id"]: r for r in chat.examples(turns).collect()}
    assert whole[1]["prompt"] == "<|system|>\nbe kind\n<|user|>\nhello\n<|assistant|>\nhi\n<|user|>\nand?\n"
    assert whole[1]["chosen"] == "<|assistant|>\nfine\n<|user|>\nok\n" and whole[1]["rejected"] == "<|assistant|>\nbad\n"
    assert whole[2]["prompt"] == "" and whole[5]["prompt"] == "<|user|>\n\n"


def test_swapped_replies(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"), (2, 2, "user", "u"),
            (3, 0, "user", "only"), (None, 0, "user", "x")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    good, bad = chat.swapped_replies(talk)
    assert good.count() == 6
    assert sorted(tuple(r) for r in bad.collect()) == [
        (1, 0, "user", "q1"), (1, 1, "assistant", "a2"), (2, 0, "user", "q2"), (2, 2, "user", "u"), (3, 0, "user", "only")]


def test_main_path_is_native_and_empty_tables(spark):
    good, bad = sides(spark, [], [])
    turns = chat.preference_turns(good, bad)
    assert turns.collect() == []
    plan = turns._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_paired_replies_equal_both_tables_grouped(spark):
    rows = [(c, t, "assistant" if (c + t) % 2 else "user", f"text {c * t % 5}") for c in range(40) for t in range(c % 7)]
    rows += [(3, 1, "assistant", "again"), (3, 1, None, "a"), (5, 4, "user", "tie"), (5, 4, None, None), (7, 2, "assistant", None),
             (90, 1, "assistant", "alone"), (91, 0, "user", "no reply"), (92, 0, "assistant", "x" * 200_000), (None, 1, "user", "x"),
             (93, None, "assistant", "x"), rows[9], rows[10]]
    talk = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, kept string")
    want = chat.preference_turns(*chat.swapped_replies(talk))
    got = chat.rendered_turns(chat.paired_replies(talk))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 60 and chat.rendered_turns(chat.paired_replies(talk.limit(0))).collect() == []
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
