import math
import random
from collections import Counter

import numpy as np

from huemill.llm import pseudo_likelihood as pl


def corpus(seed, n):
    """Words come in a fixed order of kinds, so neighbours tell a lot."""
    r = random.Random(seed)
    kinds = [["the", "a"], ["red", "big", "old"], ["cat", "dog"], ["runs", "sits"]]
    return [" ".join(r.choice(kinds[i % 4]) for i in range(r.randint(8, 60))) for _ in range(n)]


def loop_score(model, text, seen, total):
    """The definition, word by word."""
    p, words = model.network.p, (text or "").lower().split()
    classes, out = model.classes(), 0.0
    ids = [0] * 3 + [classes[w] for w in words] + [0] * 3
    for k, w in enumerate(words):
        near = [ids[k + j] for j in (0, 1, 2, 4, 5, 6)]
        x = np.tanh(p["h"] + sum(p["s"][j] * p["e"][i] for j, i in enumerate(near)))
        g, m = divmod(ids[k + 3], model.network.per)
        for z, at in ((p["g"] @ x + p["gb"], g), (p["o"][g] @ x + p["ob"][g], m)):
            out += math.log(math.exp(z[at]) / np.exp(z).sum())
        if w not in model.words:
            out += math.log((seen[w] + 1) / (total[ids[k + 3]] + 1))
    return out


def test_gradient_by_finite_differences():
    r = np.random.default_rng(3)
    net = pl.Network(3, 4, 5).biased(np.arange(12.0))
    net.p = {k: r.standard_normal(x.shape) for k, x in net.p.items()}  # float64
    ids = np.array([0, 0, 0, *r.integers(1, 12, 30), 0, 0, 0])
    at = np.arange(3, 33)
    loss, grad, seen = net.gradient(ids, at)
    assert abs(loss + net.log_probabilities(ids, at).sum()) < 1e-9
    full = grad | {"e": np.zeros_like(net.p["e"])}
    full["e"][seen] = grad["e"]
    for name, x in net.p.items():
        for k in r.permutation(x.size)[:12]:
            old = x.reshape(-1)[k]
            sides = []
            for d in (1e-5, -1e-5):
                x.reshape(-1)[k] = old + d
                sides.append(-net.log_probabilities(ids, at).sum())
            x.reshape(-1)[k] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - full[name].reshape(-1)[k]) < 1e-4, name


def test_held_out_order(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(2, 600))), "doc_id long, text string").repartition(2)
    model = pl.fit(docs, 4, 4, 4, rounds=12, rate=0.5)
    r, held = random.Random(5), corpus(3, 40)
    mixed = []
    for t in held:
        w = t.split()
        r.shuffle(w)
        mixed.append(" ".join(w))
    rows = [(i, t, 3) for i, t in enumerate(held + mixed)] + [(100, None, 1), (101, "", 1), (None, "the cat", 1), (5, held[5], 3)]
    got = pl.score(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), model).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    assert sum(by[i].mean_log_likelihood > by[i + 40].mean_log_likelihood for i in range(40)) >= 39
    assert (by[100].n_words, by[100].log_likelihood, by[100].mean_log_likelihood) == (0, 0.0, None)
    # near the entropy of the source: the kind of a word is known from both sides, two or three words are left
    assert -1.2 < np.mean([by[i].mean_log_likelihood for i in range(40)]) < -0.6


def test_every_word_is_scored_as_itself(spark):
    texts = ["the cat sat", "the bat sat", "the cat ran", "the rat ran a cat", "the cat sat", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter(w for t in texts for w in (t or "").split())
    rows = [*enumerate(texts), (10, "the xqat sat"), (11, "The cat sat bat bat xqat"), (11, "The cat sat bat bat xqat")]
    for head in (0, 2, 100):
        model = pl.fit(df, 2, 4, 6, head=head)
        assert model.words == ["the"]
        classes, total = model.classes(), Counter()
        for w, n in seen.items():
            total[classes[w]] += n + 1
        got = pl.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
        assert len(got) == len(rows)
        for r in got:
            text = dict(rows)[r.doc_id]
            assert abs(r.log_likelihood - loop_score(model, text, seen, total)) < 1e-4
            assert r.n_known == sum(seen[w] >= 2 for w in (text or "").lower().split())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = pl.fit(df, 2, 4, 3)
    assert np.allclose(model.network.log_probabilities(np.array([0, 0, 0, 5, 0, 0, 0]), np.array([3])), np.log(1 / 8), atol=0.01)
    assert pl.score(df, model).count() == 0


def test_one_look_gives_class_and_place():
    words = [f"w{k}" for k in range(40)]
    texts = [["w3", "new", "w39", "w5"], [], ["other", "w0"], ["é", "w7", "w7"]]
    for own, texts_ in ((5, texts), (0, texts), (40, texts), (5, []), (5, [[]])):
        ids, at = pl.Classes(words[:own], 64, 16).of(texts_)
        got, places, place = pl.Listed(words, own, 64, 16).of(texts_)
        assert got.tolist() == ids.tolist() and places.tolist() == at.tolist()
        assert [words[k] if k >= 0 else None for k in place.tolist()] == [w if w in words else None for t in texts_ for w in t]
