from quarrylight.llm import chat


def brute(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    flat = {}
    for c, t in convs.items():
        flat.setdefault(tuple((r, x) for _, r, x in sorted(t)), []).append(c)
    out = {}
    for t, ids in flat.items():
        if not any(len(o) > len(t) and o[: len(t)] == t for o in flat):
            out[min(ids)] = (len(t), len(ids), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.format_chats(df).collect()
    assert {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in got} == brute(rows)


def test_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = [(None, 0, "user", "x"), (900, None, None, None), (901, 0, "user", "a"), (901, 0, "user", "a"), (901, 0, "user", "b"), (902, 0, "user", "a")]
    check(spark, rows + odd)


def test_snapshots_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    talk = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(40)]
    rows = [(c, i, *talk[i]) for c, n in enumerate([1, 3, 4, 5, 8, 9, 40, 40, 17]) for i in range(n)]
    rows += [(50, i, *talk[i]) for i in range(6)] + [(50, 6, "user", "else")]
    check(spark, rows)


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
