import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from huemill.llm import similarity as sim
from huemill.llm.components import components


def brute_set(t):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(docs):
    sets = [(d, brute_set(t)) for d, t in docs]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                r, s = sorted((root(a), root(b)))
                parent[s] = r
    return sorted(((d, len(x), None if d is None else root(d)) for d, x in sets), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 3000)}"
    common = [word() for _ in range(60)]
    docs = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([1, 3, 4, 5, 6, 9, 14, 30, 80, 300]))]
        for _ in range(r.choice([1, 2, 3, 6, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(w) // 25, len(w) // 40])):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w += common
            if r.random() < 0.2:
                base = w
            docs.append(r.choice([" ", "\n"]).join(x.upper() if r.random() < 0.01 else x for x in w))
    docs += ["", None, "one", "one", "ONE", "two words", " \t"]
    r.shuffle(docs)
    out = list(enumerate(docs))
    return out + [(5, out[5][1]), (None, out[7][1]), (6, "another text under an id that is taken")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_definition(spark, seed, monkeypatch):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_shingles int").repartition(3)
    assert sorted(map(tuple, sim.groups(df).collect()), key=str) == brute(docs)


def test_big_cells_and_representatives(spark):
    """A group too large for all its pairs, of copies that differ from the first and from one another."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for d in range(1, 60):
        w = list(base)
        for _ in range(2):
            w[r.randrange(120)] = f"x{r.random()}"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert sorted(map(tuple, sim.groups(df).collect()), key=str) == want
    kept = sorted(x.doc_id for x in sim.representatives(df.union(df)).collect())
    assert kept == sorted({c for *_, c in want})


def chained(seed):
    """A large group whose members link only through others: each is a few words away from the one before it, far from the first."""
    r = random.Random(seed)
    w = [f"b{i}" for i in range(200)]
    docs = []
    for d in range(90):
        docs.append((d, " ".join(w)))
        for _ in range(2):
            w[r.randrange(200)] = f"x{r.random()}"
    r.shuffle(docs)
    return docs


def test_chain_of_links(spark, monkeypatch):
    docs = chained(4)
    want = brute(docs)
    assert len({c for *_, c in want}) == 1
    for few, block in ((16, 2048), (2, 7)):
        monkeypatch.setattr(sim, "FEW", few)
        monkeypatch.setattr(sim, "BLOCK", block)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, sim.groups(df).collect()), key=str) == want


def written(spark):
    """Bytes that all shuffles so far have written."""
    time.sleep(0.3)
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_texts_without_candidates_do_not_move(spark):
    r = random.Random(6)
    word = lambda: f"{r.getrandbits(160):040x}"
    texts = [[word() for _ in range(100)] for _ in range(400)]
    docs = [(d, " ".join(w)) for d, w in enumerate(texts)] + [(400 + d, " ".join([*texts[d], word()])) for d in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).localCheckpoint()
    before = written(spark)
    got = {x.doc_id: x.component_id for x in sim.groups(df).collect()}
    assert got == {d: d - 400 if d >= 400 else d for d, _ in docs}
    assert written(spark) - before < 0.4 * sum(len(t) for _, t in docs)


def test_map_of_wanted_documents(spark):
    df = spark.createDataFrame([(d if d % 9 else -d, str(d)) for d in range(3000)] + [(None, "")], "doc_id long, text string").repartition(4)
    for step, bits in ((7, 10), (7, 16), (5000, 10)):
        named = df.select("doc_id").where(f"doc_id % {step} = 0 or doc_id is null")
        got = {x.text for x in sim.among(df, "doc_id", sim.wanted(named, bits), bits).collect()}
        assert got >= {x.text for x in df.where(f"doc_id % {step} = 0 or doc_id is null").collect()}
        assert len(got) < 500 * (3 if bits == 10 else 1)
    none = sim.wanted(df.select("doc_id").limit(0), 10)
    assert sim.among(df, "doc_id", none, 10).count() == 0


def test_columns_of_inner_names(spark):
    names = ["node", "component", "cell", "doc", "a", "b", "n", "count", "_node"]
    df = spark.createDataFrame([(1, "a b c d e f", *range(9)), (2, "a b c d e f", *range(9)), (None, "a", *range(9)), (None, "a", *range(9))], f"doc_id long, text string, {', '.join(f'{c} int' for c in names)}")
    kept = sorted(map(tuple, sim.representatives(df).collect()), key=str)
    assert kept == sorted([(1, "a b c d e f", *range(9)), (None, "a", *range(9))], key=str)
    assert sim.groups(df).count() == 4


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sim.groups(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.floats(0, 1), st.floats(0, 1))
def test_linked_sets_share_a_key_and_bits(n, seed, cut, hot_share):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(1, 2**64 - 1, n, dtype=np.uint64))
    drop = int(cut * len(a) / 7)
    b = np.unique(np.concatenate([a[drop:], r.integers(1, 2**64 - 1, drop, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    flat, sizes = np.concatenate([a, b]), np.array([len(a), len(b)])
    listed = np.concatenate([sim.first_cells(flat, sizes, up, 75, sim.bands())[1] for up in (0, 1)])
    listed = r.permutation(np.unique(listed))[: int(hot_share * len(listed))]
    if 100 * both >= 75 * (len(a) + len(b) - both):
        who, up, key, _ = sim.sketch(flat, sizes, sim.Frequent(listed))
        one, two = (set(zip(key[who == k].tolist(), up[who == k].tolist(), strict=True)) for k in (0, 1))
        assert any(x == y and min(u, v) == 0 for x, u in one for y, v in two)
    bits, room = sim.bits_of(flat, sizes)
    raw = bits.tobytes()
    assert sim.distances([raw[: room[0]]], [raw[room[0] :]])[0] <= len(a) + len(b) - 2 * both


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    parent = list(range(26))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
