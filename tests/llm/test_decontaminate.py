import hashlib
import re

import pytest

from huemill.llm import decontaminate as dc


def ws(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k):
    wins = {}
    for i, t in items:
        w = ws(t)
        for s in range(max(1, len(w) - k + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + k]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, met = ws(t), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= {*range(s, s + len(win))}
                    met |= ids
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(10, "One two, THREE four five six"), (9, "hello"), (8, None), (7, ""), (6, "!!"), (5, "été à la mer"), (9, "hello"), (None, "three four five"), (4, "a b a b a b")]
DOCS = [(1, "zero one two three-four five six seven"), (2, "HELLO! hello\thello"), (3, None), (4, ""), (5, "L'été à la mer… helloo"), (6, "a b a b a b a b a"), (6, "a b a b a b a b a"), (None, "one two three four five six hello"), (7, "x " * 50_000 + "hello " + "y " * 50_000)]


@pytest.mark.parametrize("max_bytes", [1 << 20, 200])
def test_against_definition(spark, max_bytes):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(tuple, dc.digest(dc.find_hits(docs, items, 3, max_bytes)).collect()), key=str)
    assert got == brute(DOCS, ITEMS, 3)
    kept = dc.clean(docs, items, 3, max_bytes).collect()
    assert sorted((r.doc_id, r.text, r.item_id) for r in kept) == sorted((d, t, 1) for d, t in DOCS if (d, t) in [(3, None), (4, "")])
    assert dc.find_hits(docs, items.limit(0), 3).where("size(starts) > 0").count() == 0
    assert dc.find_hits(docs.limit(0), items, 3).count() == 0


def test_spans_are_of_the_original():
    found = dc.automaton({w: ["1"] for w in dc.windows_of("Été two", 10)})
    text = "çà — ÉTÉ? été,  TWO! x"
    _, s, e, _ = dc.hits_of(text, found)
    assert [text[a:b] for a, b in dc.original_spans(text, s, e)] == []
    found = dc.automaton({w: ["1"] for w in dc.windows_of("été two", 10)})
    _, s, e, _ = dc.hits_of(text, found)
    assert [text[a:b] for a, b in dc.original_spans(text, s, e)] == ["été,  TWO"]
