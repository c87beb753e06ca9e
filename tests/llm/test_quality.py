import math
import re
import time
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from huemill.llm import quality as q

N = 64


def base(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    hit = set()
    for i in range(len(ws) - 2):
        if seen[tuple(ws[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def cells(t, n=N):
    runs = re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]+", t or "")
    one = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in runs]
    raw = lambda h: h.to_bytes(8, "little")
    two = [xxhash.xxh64(raw(b), seed=xxhash.xxh64(raw(a), seed=42).intdigest()).intdigest() for a, b in zip(one, one[1:])]
    return [signed(h) % n for h in one + two]


def brute(docs, labels, threshold, n=N):
    good = {d for d, v in labels if v == 1 and d is not None}
    counts = [Counter(c for d, t in docs if keep(d) for c in cells(t, n)) for keep in (lambda d: d in good, lambda d: True)]
    logs = [[math.log((c[k] + 1) / (sum(c.values()) + n)) for k in range(n)] for c in counts]
    ratio = [a - b for a, b in zip(*logs, strict=True)] if good else [0.0] * n
    out = []
    for d, t in docs:
        b, cs = base(t), cells(t, n)
        score = sum(ratio[c] for c in cs) / len(cs) if cs else 0.0
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((d, *b, failed, round(score, 9), not failed and score >= threshold))
    return sorted(out, key=str)


def got(df, labels, threshold, n=N):
    rows = q.judge(df, labels, threshold, n).select("doc_id", *q.COUNTS, "base_failed", F.round("score", 9).alias("score"), "kept").collect()
    return sorted(map(tuple, rows), key=str)


def test_against_definition(spark):
    plain = " ".join(f"word{i % 37} and{i}" for i in range(60))
    junk = " ".join(f"w{i}*** x{i}$$$" for i in range(60))
    docs = [(1, plain), (2, junk), (3, None), (4, ""), (5, "a b c\n\nx\nx\n \nx"), (5, "a b c\n\nx\nx\n \nx"), (None, plain), (6, "la la la " * 40), (7, " \t\n"), (8, plain + " " + junk)]
    docs += [(9, " ".join(f"t{i * i % 91}" for i in range(20_000)))]
    labels = [(1, 1), (2, 0), (6, 1), (6, 1), (None, 1), (99, 1)]
    df = spark.createDataFrame([(d, t, 7, True) for d, t in docs], "doc_id long, text string, n_words int, kept boolean")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    assert got(df, lab, -0.1) == brute(docs, labels, -0.1)
    assert got(df, lab.limit(0), -0.1) == brute(docs, [], -0.1)
    assert got(df.limit(0), lab, -0.1) == []


def test_toxic_documents_go_whatever_their_length(spark):
    prose = lambda k, size: " ".join(f"w{k}x{i}" for i in range(size))
    docs, labels = [], []
    for k in range(120):
        bad = k % 6 == 0
        docs.append((k, prose(k, 120) + (" you Idiot, " if bad else " you friend, ") + prose(k + 1, 60)))
        labels.append((k, 1, int(bad)))
    docs += [(500, prose(500, 60) + " idiot. " + prose(501, 5000)), (501, prose(502, 5000)), (502, prose(503, 80) + " idiotic")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in q.judge(df, lab, -9.0).collect()}
    assert {d for d, r in rows.items() if r.toxic} == {d for d in range(0, 120, 6)} | {500}
    assert {d for d, r in rows.items() if not r.kept} == {d for d in range(0, 120, 6)} | {500}
    assert not any(r.toxic for r in q.judge(df, lab.drop("toxic"), -9.0).collect())
    # toxic documents are no part of the target: the score is that of labels without them
    trusted = [(d, v) for d, v, bad in labels if not bad]
    want = {r[0]: r[7] for r in brute(docs, trusted, -9.0)}
    got = {r.doc_id: r.score for r in q.judge(df, lab, -9.0, N).collect()}
    assert all(abs(got[d] - want[d]) < 1e-8 for d in want)


def test_columns_of_inner_names(spark):
    names = ["_counts", "_judged", "_id", "_target", "_text", "_doc", "words", "windows", "lines", "runs", "grams", "_runs", "c"]
    df = spark.createDataFrame([(1, "a b c d", *range(len(names))), (None, None, *range(len(names)))], f"doc_id long, text string, {', '.join(f'{c} int' for c in names)}")
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = q.judge(df, lab, -0.1)
    assert sorted(map(tuple, out.select(df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_filters_do_not_repeat_the_work(spark):
    """A filter on a verdict is not folded into the lambdas below it: a long text stays linear."""
    text = " ".join(f"w{i % 1000}x{i % 777} " for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    start = time.time()
    assert [r.doc_id for r in q.judge(df, lab, -9.0).where("kept and n_dup_lines = 0").select("doc_id").collect()] == [1]
    assert time.time() - start < 60


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#|é", max_size=30), min_size=10, max_size=40))
def test_base_counts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [tuple(r) for r in q.with_counts(df).select(*q.COUNTS).collect()] == [base(t) for t in texts]
