import random

import numpy as np
import pyarrow as pa

from tallyspark.llm import toxicity


def corpus(n, seed, bad=("worthless", "idiotic", "scumbag")):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        y = i % 4 == 0
        for _ in range(3 * y):
            body.insert(rng.randrange(len(body)), rng.choice(bad))
        texts.append(" ".join(body))
        labels.append(int(y))
    return texts, labels


def test_learns_and_shares_subwords():
    texts, labels = corpus(400, 1)
    scorer = toxicity.Scorer(toxicity.train(texts, labels, 0.25))
    held, truth = corpus(200, 2)
    s, y = scorer.score(pa.array(held)), np.array(truth)
    assert ((s >= 0.5) == y).mean() > 0.95
    # misspellings never met in training
    held, truth = corpus(200, 3, bad=("worthlesss", "idiotick", "scumbagg"))
    assert ((scorer.score(pa.array(held)) >= 0.5) == np.array(truth)).mean() > 0.9


def test_edges(spark):
    model = toxicity.train([], [], 0.0)
    one = toxicity.train(["a"], [1], 0.9)
    assert toxicity.Scorer(model).score(pa.array(["x", None, ""])).max() < 1e-5
    assert abs(toxicity.Scorer(one).score(pa.array([""]))[0] - 0.9) < 1e-6
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x " * 50000, "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == 3 and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_scores_do_not_depend_on_batches():
    texts, labels = corpus(60, 4)
    model = toxicity.train(texts, labels, 0.25)
    whole = toxicity.Scorer(model).score(pa.array(texts))
    small = toxicity.Scorer(model, keep=10)
    assert np.allclose(whole, np.concatenate([small.score(pa.array([t])) for t in texts]))
