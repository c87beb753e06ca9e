import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from huemill.llm import pii


def luhn(d):
    return sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
]


def brute(t):
    return [(k, m.start(), m.end()) for k, p, ok in RULES for m in re.finditer(p, t or "") if ok(m[0])]


def name(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def rows(df, **kw):
    return sorted((tuple(r) for r in pii.digest(pii.find(df, **kw)).collect()), key=str)


def want(d, t):
    b = brute(t)
    return (d, *(sum(k == x for k, *_ in b) for x in pii.KINDS), hashlib.sha256(name(b).encode()).hexdigest(), name(b), 0)


TEXTS = [
    "é a.b@c.de, x@y, q@w.e_r@t.y z@1.2.3.4 4111 1111 1111 1111 and 4111-1111-1111-1112",
    "256.1.1.1.1 1.2.3.4.5.6.7.8 000255.0.0.1 999.999.999.9999 1.2.3",
    "+1 (017) 555-7713 4929348385146306 +49.30.123456) +1 2 3 +99999999999999999 +1-234-567-89-",
    "漢字+12 345 6789a@b.c.d.. 1" + " 2" * 40,
    None,
    "",
    "1" * 30_000 + " " + "a" * 30_000 + "@" + " 1.1" * 500 + "." * 5000,
    "x@" + "a." * 20_000 + " " + "7 " * 3000 + "+1" + " " * 20_000,
    "token 4111111111111111 4111111111111111",
]


def test_base_spans_and_empty(spark):
    docs = [*enumerate(TEXTS), (0, TEXTS[0]), (None, TEXTS[1]), (1, "other 10.0.0.1")]
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, kind string")
    assert rows(df) == sorted((want(d, t) for d, t in docs), key=str)
    assert rows(df.limit(0)) == []
    got = sorted(((r.doc_id, r.text, r.kind) for r in pii.redact(df).collect()), key=str)
    clean = []
    for d, t in docs:
        out, at = [], 0
        spans = sorted((a, b, k) for k, a, b in brute(t))
        for i, (a, b, k) in enumerate(spans):
            if a < at:
                at = max(at, b)
                continue
            out += [t[at:a], f"<{k.upper()}>"]
            at = b
        clean.append((d, t if t is None else "".join(out) + t[at:], "k"))
    assert got == sorted(clean, key=str)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+ -()5é_", max_size=40), min_size=30, max_size=80))
def test_base_spans_random(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cols = pii.base_spans(df["text"])
    got = df.select("doc_id", *(c.alias(k) for k, c in cols.items())).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        assert [(k, s.start, s.end) for k in pii.KINDS for s in r[k]] == brute(t)


def test_contexts_reveal_unseen_identifiers(spark):
    docs = [(i, f"please call me +1 (555) 000-{1000 + i} now") for i in range(8)]
    docs += [(20, "please call me 555-000-7777 now"), (21, "room number 555-000-9999 is free"), (22, "ring up home 555-000-7777 now")]
    docs += [(30 + i, f"room number {100 + i} is free") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(df)).collect()}
    assert got[20] == "phone:15:27"
    assert got[21] == got[22] == got[30] == ""
    assert got[3] == "phone:15:32"
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[20] == text[3] == "please call me <PHONE> now" and text[21] == docs[9][1]


def test_patterns_come_from_the_text_before(spark):
    """Another number or identifier among the two words before a span belongs to its pattern, for seeds and candidates alike."""
    docs = [(i, f"order 12 phone +1 (555) 000-{1000 + i} now") for i in range(6)]
    docs += [(10, "order 34 phone 555-000-7777 now"), (11, "a@b.cd 7 phone 555-000-7778 and"), (12, "in 5 phone 555-000-7779 and")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = {r.text: r.pattern for r in df.select(F.explode(pii.candidates(df["text"]))).select("col.*").collect()}
    assert seen["555-000-7777"] == seen["555-000-7778"].replace("0 phone", "00 phone") == "00 phone"
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(df)).collect()}
    assert (got[10], got[11], got[12]) == ("phone:15:27", "email:0:6", "")


def test_secrets(spark):
    """Long hexadecimal strings make their context one of secrets, which finds others; elsewhere they are no spans."""
    h = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    docs = [(i, f'some token = "{h(i)}"### more') for i in range(8)] + [(20, 'a token = "Zk3_9aLq0-Xb77TtY1c" end'), (21, f"commit {h(30)} done"), (22, 'a token = "12" end')]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(df)).collect()}
    assert (got[0], got[20], got[21], got[22]) == ("secret:14:54", "secret:11:30", "", "")
    assert {r.text for r in pii.redact(df).where("doc_id = 20").collect()} == {'a token = "<SECRET>" end'}


def test_precision_on_given_documents(spark):
    """All spans that contexts add over a whole table are the quoted tokens, and every quoted token is found."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, s) for r in pii.digest(pii.find(df)).collect() for s in r.spans.split(",") if s.startswith("secret")}
    want = {(r.doc_id, f"secret:{m.start(1)}:{m.end(1)}") for r in df.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")}
    assert got == want and want


def test_many_matches_and_columns_of_inner_names(spark):
    names = ["text_hash", "more", "_id", "_hash", "of", "hash", "tokens", "email"]
    text = "7a " * 3000 + "x@y.z"
    df = spark.createDataFrame([(1, text, *map(str, range(8)))], f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}")
    assert tuple(pii.redact(df).first()) == (1, "7a " * 3000 + "<EMAIL>", *map(str, range(8)))
    places = df.select(pii.matches(df["text"], "[0-9]", lambda s: s == "7").alias("m")).first().m
    assert [m.start for m in places] == list(range(0, 9000, 3))
