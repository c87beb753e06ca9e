import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from huemill.llm import vector_codes as vc


def brute(rows, parts, entries, rounds):
    """Rows of (vec_id, vector, label) by the definition, in loops over Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    d = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == d * parts]
    cut = lambda v, p: v[p * d : p * d + d]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(v, p):
        return min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))

    for _ in range(rounds):
        codes = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for i, v, lab in kept:
        c = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e in c), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(c)), lab))
    of = {}
    for _, _, e, lab in out:
        of[lab] = of.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, of[lab], sha, lab) for i, c, e, lab in out), key=str)


def run(spark, rows, parts=4, entries=8, rounds=2, n=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(n)
    return sorted(map(tuple, vc.compress(df, parts, entries, rounds).collect()), key=str)


def vectors(r, n, dims, spread=2.0):
    f = lambda: float(np.float32(r.gauss(0, spread)))
    return [(k, [f() for _ in range(dims)], r.choice([None, 0, 1, 2])) for k in range(n)]


def test_equals_loops(spark):
    rows = vectors(random.Random(5), 150, 16)
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[3][1], None), (900, None, 0), (901, [1.0] * 15 + [None], 0), (902, [float("nan")] + [0.0] * 15, 0), (903, [float("inf")] + [0.0] * 15, 0), (904, [], 1), (905, [1.0] * 8, 1)]
    assert run(spark, rows) == brute(rows, 4, 8, 2)


def test_ties_and_unused_entries(spark):
    rows = [(k, [float(k % 3)] * 8, k % 2) for k in range(40)]
    assert run(spark, rows) == brute(rows, 4, 8, 2)


def test_negative_means_go_down(spark):
    rows = [(k, [-x / 256 for x in (k % 5, 1, k % 7, 2)], None) for k in range(30)]
    assert run(spark, rows, parts=2, entries=3) == brute(rows, 2, 3, 2)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = vectors(random.Random(1), 3, 8)
    assert run(spark, rows) == brute(rows, 4, 8, 2)
    assert run(spark, rows[:0]) == []
    assert run(spark, [(1, None, 1)]) == []


def test_partitions_do_not_matter(spark):
    rows = vectors(random.Random(2), 200, 16)
    assert run(spark, rows, n=1) == run(spark, rows, n=16)


def test_wrong_sizes(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0] * 6, 0)])
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0] * 8, 0)], entries=257)


def test_codes_stand_for_vectors(spark):
    df = spark.createDataFrame(vectors(random.Random(9), 60, 8), "vec_id long, embedding array<float>, label int")
    whole = vc.integer_vectors(df)
    books = vc.fit(whole, 4, 16, 1)
    of = {r.vec_id: r.v for r in whole.collect()}
    for r in vc.encode(whole, books).collect():
        assert r.error == sum((a - b) ** 2 for a, b in zip(of[r.vec_id], vc.decoded(books, r.code), strict=True))


def test_clashing_columns(spark):
    rows = vectors(random.Random(4), 20, 8)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, code string, v int, error int")
    assert sorted(map(tuple, vc.compress(df, 4, 8, 2).collect()), key=str) == brute(rows, 4, 8, 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 40), st.integers(1, 5), st.sampled_from([1, 3, 500]))
def test_search_is_exact(seed, n, m, dims, size):
    r = np.random.default_rng(seed)
    x, book = r.integers(-size, size + 1, (n, dims)), r.integers(-size, size + 1, (m, dims))
    d = ((x[:, None] - book) ** 2).sum(axis=2)
    code, least = vc.nearest(x, book)
    assert code.tolist() == d.argmin(axis=1).tolist() and least.tolist() == d.min(axis=1).tolist()
