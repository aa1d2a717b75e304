import random

import numpy as np

from quarrylight.llm.quality_model import fit, predict, score_quality


def test_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = fit(x[:3000], y[:3000])
    assert (((predict(model, x[3000:]) > 0.5) == y[3000:]).mean()) > 0.95
    assert model["pairs"][0] in ((1, 0), (0, 1))


def test_held_out_and_contract(spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(800):
        good = r.random() < 0.7
        words = [r.choice(["alpha", "beta", "gamma", "delta", "of", "the", "epsilon"]) + r.choice(["", "", ","]) for _ in range(60)]
        docs.append((i, " ".join(words) if good else "!! ".join(w.upper() for w in words), 1))
        labels.append((i, int(good)))
    docs += [(5000, None, 1), (5001, "", 1), (5002, "x " * 300_000, 1), (5002, "x " * 300_000, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, predicted int").repartition(4)
    out = score_quality(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == len(docs) and all(0 <= o["score"] <= 1 for o in out)
    truth = dict(labels)
    held = [o for o in out if o["held_out"] and o["doc_id"] in truth]
    assert sum(o["predicted"] == truth[o["doc_id"]] for o in held) > 0.97 * len(held)
