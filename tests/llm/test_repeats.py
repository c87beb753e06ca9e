import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from huemill.llm import passage_dedup, suffix_dedup
from huemill.llm import superkmers as sk


def least(x):
    return -(2**63) if x is None else x


def brute(docs, cut, size, own):
    """Removed symbols of each document by the definition."""
    places = defaultdict(list)
    for k, (d, t) in enumerate(docs):
        s = cut(t)
        for i in range(len(s) - size + 1):
            places[tuple(s[i : i + size])].append((least(d), t, i))
    first = {w: min(p)[0] for w, p in places.items()}
    mine = {w: {(d, t): min(i for e, u, i in p if (e, u) == (d, t)) for d, t, _ in p} for w, p in places.items()} if own else {}
    out = []
    for d, t in docs:
        s, gone = cut(t), set()
        for i in range(len(s) - size + 1):
            w = tuple(s[i : i + size])
            if first[w] < least(d) or own and mine[w][least(d), t] < i:
                gone |= {*range(i, i + size)}
        out.append((d, s, gone))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "été", "and", "x", "longer-word", "漢字", "a"] + [f"w{i}" for i in range(40)]
    passages = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60))) for _ in range(12)]
    docs = []
    for i in range(120):
        parts = [r.choice([r.choice(passages), r.choice(passages), " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40)))]) for _ in range(r.randint(0, 5))]
        docs.append((i, r.choice([" ", "\n", "  ", ""]).join(parts)))
    docs += [(3, docs[7][1]), (4, docs[4][1]), (None, docs[9][1]), (500, None), (501, ""), (502, "ab " * 400), (503, "ab " * 400), (504, "x" * 3000)]
    docs += [(505, (" ".join(passages) + "\n") * 6)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_bytes int").repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 50).collect()), key=str)
    want = []
    for d, s, gone in brute(docs, lambda t: (t or "").encode(), 50, False):
        edges = sorted(i for i in gone if i - 1 not in gone), sorted(i + 1 for i in gone if i + 1 not in gone)
        want.append((d, len(s), len(gone), list(zip(*edges, strict=True)), bytes(b for i, b in enumerate(s) if i not in gone)))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, kept int").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in passage_dedup.remove_repeats(df, 20).collect()), key=str)
    want = [(d, len(s), len(gone), b" ".join(w for i, w in enumerate(s) if i not in gone).decode()) for d, s, gone in brute(docs, lambda t: (t or "").encode().split(), 20, True)]
    assert got == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df).count() == 0
    assert passage_dedup.remove_repeats(df).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=8), st.integers(8, 20))
def test_refined_buckets_agree_with_prefixes(parts, depth):
    data = b"".join(p * 2 for p in parts)
    got = suffix_dedup.refine(np.frombuffer(data, np.uint8), depth) if len(data) >= 8 else []
    prefixes = [data[i : i + depth] for i in range(max(0, len(data) - depth + 1))]
    if len(data) >= 8:
        assert len(got) == len(prefixes)
        ranks = {p: k for k, p in enumerate(sorted({*prefixes}))}
        order = {b: k for k, b in enumerate(sorted({*got.tolist()}))}
        assert [order[b] for b in got.tolist()] == [ranks[p] for p in prefixes]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abn", max_size=60))
def test_suffix_array(text):
    data = text.encode()
    assert suffix_dedup.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_sliding_min(values, w):
    if len(values) >= w:
        assert sk.sliding_min(np.array(values), w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


def test_strings_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(sk, "range_hashes", lambda d, a, b: np.zeros(len(a), np.uint64))
    data = np.frombuffer(b"aabbaacc", np.uint8)
    assert sk.classes(data, np.array([2, 2, 2, 2])).tolist() == [0, 1, 0, 3]


@pytest.mark.parametrize("find", [lambda df: suffix_dedup.remove_repeats(df, 50), lambda df: passage_dedup.remove_repeats(df, 20)])
def test_buckets_follow_the_text(spark, monkeypatch, find):
    """A task's share stays bounded where the session has few partitions for its input, with the same result."""
    df = spark.createDataFrame(corpus(3), "doc_id long, text string").repartition(5)
    want = sorted(find(df).collect(), key=str)
    size = sum(len((t or "").encode()) for _, t in corpus(3))
    monkeypatch.setattr(sk, "STRINGS", size // 20)
    monkeypatch.setattr(sk, "TEXTS", size // 30)
    out = find(df)
    assert sk.buckets_of(df)[0] >= 20
    assert out.rdd.getNumPartitions() >= 30
    assert sorted(out.collect(), key=str) == want


@pytest.mark.parametrize("kind", ["bytes", "words"])
@pytest.mark.parametrize("held", [1 << 30, 20_000, 1])
def test_windows_of_one_gram_are_told_apart(monkeypatch, kind, held):
    """A bucket of one minimiser is compared in bounded parts, and only what fits is held, with the repeats of the definition."""
    r = random.Random(5)
    symbols, compare, span, gram, own = (suffix_dedup._bytes, suffix_dedup._compare(50), 50, 8, False) if kind == "bytes" else (passage_dedup._words, passage_dedup._compare(20), 20, 3, True)
    words = [f"{r.choice('bcdf')}{r.choice('aeiou')}{i}" for i in range(300)]
    texts = [" ".join([*r.choices(words, k=14), "one very common line", *r.choices(words, k=14)]) for _ in range(150)]
    texts += [r.choice(texts)[r.randint(0, 40) :] for _ in range(60)] + ["zz " * 60] * 2
    r.shuffle(texts)
    parts = []
    for at in range(0, len(texts), 10):
        data = [t.encode() for t in texts[at : at + 10]]
        body, bounds, first, last, grams = symbols(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        starts, counts, _, owner = sk.runs(grams * np.uint64(0), bounds, span, gram)  # all grams count as one
        a, b = first[starts], last[starts + counts + span - 2]
        parts.append(sk.Strings(sk.gather(body, a, b - a), b - a, counts, np.zeros(len(a), np.uint8), np.arange(len(a)), at + owner, at + owner, starts - bounds[owner]))
    monkeypatch.setattr(sk, "WINDOWS", limit := 2_000 if kind == "bytes" else 500)
    monkeypatch.setattr(sk, "BYTES", 20_000)
    monkeypatch.setattr(sk, "CHUNK", 5_000)
    monkeypatch.setattr(sk, "HELD", held)
    most = []

    def bounded(s):
        most.append(int(s.counts.sum()))
        return compare(s)

    gone = {}
    for doc, _, place, n in sk._repeats(iter(parts), symbols, bounded, span, gram, own):
        for d, p, k in zip(doc.tolist(), place.tolist(), n.tolist(), strict=True):
            gone.setdefault(d, set()).update(range(p, p + k))
    want = brute(list(enumerate(texts)), lambda t: t.encode() if kind == "bytes" else t.encode().split(), span, own)
    assert gone == {d: x for d, _, x in want if x}
    assert sum(most) > 2 * max(most) and max(most) <= 2 * limit
