import random

from quarrylight.llm.toxicity import score_toxicity


def corpus(n, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(20, 90))]
        bad = r.random() < 0.25
        if bad:
            words[r.randrange(len(words))] = r.choice(["Rotten!", "vile", "scum,"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus(1600)
    docs += [(9000, None, "x"), (9001, "", "x"), (9002, "vile " * 200_000, "x"), (9002, "vile " * 200_000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(5)
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = score_toxicity(d, y).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert {r["predicted"] for r in rows if r["doc_id"] == 9002} == {1}


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(d, y).first()["score"] == 0.0
