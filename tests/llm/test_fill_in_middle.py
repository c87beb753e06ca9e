import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from huemill.llm import fill_in_middle as fim


def brute(doc_id, text, seed=1):
    text = text or ""
    us = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(us) + 1), h2 % (len(us) + 1)))
    p, m, s = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(us), "plain", None, None, None, text
    if h4 % 100 < 20:
        return len(us), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(us), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def run(spark, rows):
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "pos int, doc_id long, text string")
    out = fim.transform(df)
    back = out.withColumn("back", fim.restored(out["output"], out["form"])).orderBy("pos").collect()
    for (d, t), r in zip(rows, back, strict=True):
        assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == brute(d, t)
        assert r.back == (t or "")
    return back


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("abZ \n\x00\x01\x0212<>PSM$\\é漢😀"), st.characters(exclude_categories=["Cs"])), max_size=40))), min_size=1, max_size=30))
def test_any_text(spark, rows):
    run(spark, rows)


def test_every_form_and_hard_texts(spark):
    hard = ["", None, "a", "\x01", "\x02", "\x02\x01", "\x021\x022", "\x01\x01a\x02", "$0 \\1", "<", "<P", "<P>", "x<S>y", "<M", "<<S", "P>", "😀a😀", "é", "́x"]
    rows = [(i, t) for i in range(60) for t in hard] + [(7, "same text here"), (7, "same text here"), (None, "no id")]
    forms = {r.form for r in run(spark, rows)}
    assert forms == {"plain", "psm", "spm"}


def test_long_text(spark):
    long = " ".join(f"w{chr(97 + i % 26)}{i}" for i in range(200_000))
    run(spark, [(3, long), (4, "a" * 300_000), (5, "." * 300_000)])


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two three", 5, "x", "y", 1)], "doc_id long, text string, n int, form string, mark string, h1 int")
    out = fim.transform(df)
    assert out.columns == ["doc_id", "text", "mark", "h1", "n", "form", "prefix", "middle", "suffix", "output"]
    r = out.collect()[0]
    assert (r.mark, r.h1, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == ("y", 1, *brute(1, "one two three"))
    assert fim.transform(df.limit(0)).count() == 0
    assert fim.digest(fim.transform(df)).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_no_python_and_no_exchange(spark):
    plan = fim.digest(fim.transform(spark.createDataFrame([(1, "a b")], "doc_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
