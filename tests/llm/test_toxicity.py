import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from huemill.llm import toxicity as tx


def terms_of(text):
    """Counts of the terms of a text by the definition, as byte strings; whole words end with a full stop."""
    out = Counter()
    for w in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()):
        out[w + b"."] += 1
        for k in tx.PREFIXES:
            if k < len(w):
                out[w[:k]] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcABC \n.é9"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=6))
def test_hashes_stand_for_terms(texts):
    got = Counter((int(d), int(x)) for of, h in tx.term_hashes(texts) for d, x in zip(of, h, strict=True))
    want = Counter()
    for d, t in enumerate(texts):
        for n in terms_of(t).values():
            want[d, n] += 1
    per = Counter()
    for (d, _), n in got.items():
        per[d, n] += 1
    assert per == want


def test_equal_terms_have_equal_hashes():
    long = "x" * 500
    a = Counter(int(x) for _, h in tx.term_hashes([f"Trash trashed {long}"]) for x in h)
    b = Counter(int(x) for _, h in tx.term_hashes(["the", f"{long}, TRASHED! trash\nno"]) for x in h)
    assert set(a) - set(b) == set()
    whole = lambda text: list(tx.term_hashes([text]))[-1][1].tolist()
    assert whole(long + "y") != whole(long + "z") and whole(long + "y") == whole(long + "Y")
    assert sum(len(h) for _, h in tx.term_hashes([])) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 500), st.integers(2, 60), st.integers(1, 12))
def test_nearest_is_exact(seed, n, terms, k):
    r = random.Random(seed)
    rows = sorted({tuple(sorted(r.sample(range(terms), r.randint(1, min(terms, 8))))) for _ in range(n)})
    weights = np.array([r.uniform(0.1, 5) for _ in range(terms)])
    index = tx.Index.build([(list(e), 0.5, 1, i) for i, e in enumerate(rows)], weights, 0.1)
    for _ in range(5):
        q = np.array(sorted(r.sample(range(terms), r.randint(1, min(terms, 8)))))
        norm = lambda e: math.sqrt(sum(weights[x] ** 2 for x in e))
        cos = [round(sum(weights[x] ** 2 for x in set(e) & set(q.tolist())) / norm(e) / norm(q), 7) for e in rows]
        want = sorted(((-c, i) for i, c in enumerate(cos) if c > 0))[:k]
        best, cosines, _ = index.nearest(q, k)
        assert cosines.tolist() == pytest.approx([-c for c, _ in want], abs=1e-6)
        # within equal cosines the number decides; rounding may order near-equal ones either way
        assert len(set(best.tolist())) == len(best) and all(abs(cos[e] - c) < 1e-6 for e, c in zip(best, cosines, strict=True))


def test_blocks_are_skipped():
    """Examples of one word each, one block to a word: the search opens the query's block and no more."""
    weights = np.ones(64 + 20)
    rows = [([w, 64 + k % 20] if k % 2 else [w], 1.0, 1, 0) for w in range(64) for k in range(tx.BLOCK)]
    index = tx.Index.build(rows, weights, 0.0)
    best, cosines, opened = index.nearest(np.array([5]), 10)
    assert cosines[-1] == 1.0 and opened <= 2 and len(index.shares) == 64 * tx.BLOCK


BAD = ["idiot", "scum", "trash", "moron", "clown"]


def corpus(seed=3, n=900):
    """Documents of random words; toxic ones have two to six of ten insults, in one of two languages by compounds of a stem."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 7)))
    docs, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(r.choice([20, 60, 400]))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(2, 6)):
                ws[r.randrange(len(ws))] = r.choice(BAD).upper() if i % 2 else "grobian" + word()
        docs.append((i, " ".join(ws), "xx", r.choice(["a", "b"])))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    out = {r.doc_id: r for r in tx.score(*frames(spark, docs, labels)).collect()}
    return docs, labels, out


def test_held_out_accuracy(scored):
    _, labels, out = scored
    held = [(t, out[i]) for i, _, t in labels if out[i].held_out]
    assert len(held) > 150
    caught = [r.predicted for t, r in held if t]
    assert sum(caught) >= 0.95 * len(caught)
    assert sum(r.predicted for t, r in held if not t) <= 0.01 * len(held)
    # calibration: the squared error is far below that of the base rate
    rate = sum(t for t, _ in held) / len(held)
    assert sum((r.score - t) ** 2 for t, r in held) < 0.25 * len(held) * rate * (1 - rate)


def test_columns(scored):
    docs, labels, out = scored
    toxic = dict((i, t) for i, _, t in labels)
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert all(zlib.crc32(str(e.doc_id).encode()) % 4 != 2 for e in r.evidence)
        assert (r.n_terms > 0) == bool(r.evidence)
    worst = max(out.values(), key=lambda r: r.score)
    assert toxic[worst.evidence[0].doc_id] == 1 and worst.evidence[0].cosine <= 1 + 1e-9


def test_held_out_labels_and_other_columns_change_nothing(spark, scored):
    docs, labels, out = scored
    other = [(i, t, "yy", "z") for i, t, _, _ in docs]
    flipped = [(i, 0, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, _, t in labels]
    again = {r.doc_id: r.score for r in tx.score(*frames(spark, other, flipped)).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_score_is_the_vote_of_brute_force_neighbours(spark, scored):
    """Terms, weights, examples and votes once more, in loops."""
    docs, labels, out = scored
    toxic = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    counts = {i: terms_of(t) for i, t, _, _ in docs}
    bad, fine = sum(toxic.values()), len(toxic) - sum(toxic.values())
    a, b = Counter(), Counter()
    for i, t in toxic.items():
        (a if t else b).update(counts[i].keys())
    xlog = lambda o, e: o * math.log(o / e) if o else 0.0
    found = []
    n = bad + fine
    for w, x in a.items():
        y = b[w]
        g = 2 * (xlog(x, (x + y) * bad / n) + xlog(y, (x + y) * fine / n) + xlog(bad - x, (n - x - y) * bad / n) + xlog(fine - y, (n - x - y) * fine / n))
        if x >= tx.LEAST and x + y < n and g >= tx.SURE and math.log((x + 0.5) / (bad + 1)) - math.log((y + 0.5) / (fine + 1)) >= tx.RATIO:
            found.append(w)
    vec = {i: frozenset((w, k) for w in found for k in range(min(c[w], tx.REPEATS))) for i, c in counts.items()}
    df = Counter(e for v in vec.values() for e in v)
    weight = {e: math.log1p(len(docs) / d) for e, d in df.items()}
    of = {}
    for i, t in toxic.items():
        of.setdefault(vec[i], []).append(t)
    none = of.pop(frozenset(), [])
    base = (sum(none) + bad / n) / (len(none) + 1)
    norm = lambda v: math.sqrt(sum(weight[e] ** 2 for e in v))
    checked = 0
    for i, v in vec.items():
        assert out[i].n_terms == len(v)
        if not v:
            assert out[i].score == round(base, 6)
            continue
        cos = sorted(((sum(weight[e] ** 2 for e in v & x) / norm(v) / norm(x), len(t), sum(t)) for x, t in of.items() if v & x), reverse=True)
        if len(cos) > tx.NEAREST and cos[tx.NEAREST - 1][0] - cos[tx.NEAREST][0] < 1e-6:
            continue  # a tie at the last place
        by = [(c * c * m, s / m) for c, m, s in cos[: tx.NEAREST]]
        want = (sum(w * y for w, y in by) + tx.PRIOR * base) / (sum(w for w, _ in by) + tx.PRIOR)
        assert abs(out[i].score - want) < 2e-6
        checked += 1
    assert checked > 60


def test_hard_rows(spark):
    docs = [(1, None, None, None), (2, "", "x", "y"), (None, "idiot scum", "x", "y"), (3, "idiot " * 50_000, "x", "y"), (3, "idiot", "x", "y"), (3, "idiot", "x", "y"), (4, "a" * 200_000, "x", "y")]
    docs += [(i, "you idiot scum " + "plain words here" * (i % 3), "x", "y") for i in range(100, 140)] + [(i, f"plain words here {i % 7}", "x", "y") for i in range(200, 280)]
    labels = [(i, 1, 1) for i in range(100, 140)] + [(i, 1, 0) for i in range(200, 280)] + [(3, 0, None), (None, 1, 1), (100, 1, 0), (200, None, None), (999_999, 1, 1)]
    out = tx.score(*frames(spark, docs, labels)).collect()
    assert len(out) == len(docs)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.predicted for i in (None, 3, 100, 139) for r in by[i]} == {1}
    assert {r.predicted for i in (1, 2, 4, 200, 279) for r in by[i]} == {0}
    assert not by[None][0].held_out
    assert len({r.score for r in by[3]}) <= 2 and len(by[3]) == 3


def test_empty_tables_and_missing_classes(spark):
    docs, labels = frames(spark, corpus(n=40)[0], corpus(n=40)[1])
    assert tx.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in tx.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.predicted for r in tx.score(docs, labels.where("toxic = 0")).collect()} == {0}


def test_clashing_columns(spark):
    docs, labels = corpus(n=120)
    plain = {r.doc_id: r.score for r in tx.score(*frames(spark, docs, labels)).collect()}
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t, _, _ in docs], "doc_id long, text string, toxic int, _id int, _toxic int, score int")
    assert {r.doc_id: r.score for r in tx.score(df, frames(spark, docs, labels)[1].selectExpr("*", "1 AS _id", "2 AS _toxic")).collect()} == plain
