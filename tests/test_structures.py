"""Structures that stand in for loops: pointers for folds, grams for containment, runs for masks, labels for components, bounded lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from huemill.functions import color
from huemill.operators import audit, graphs, raster, search, spatial
from huemill.plans import catalogue_queries


def fold(values, tolerance):
    anchors = []
    for v in sorted(values):
        if not anchors or abs(v - anchors[-1]) > tolerance:
            anchors.append(v)
    return anchors


def test_lines_by_pointers_equal_the_fold(spark):
    r = random.Random(8)
    rows = [(k, i, None if r.random() < 0.05 else round(r.choice([r.uniform(0, 30), r.uniform(0, 3000), 4.5 * r.randint(0, 50) + 0.1]), 1)) for k in ("a", "b", None) for i in range(300)] + [("alone", 0, 7.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, y double").repartition(3)
    got = {(x.k, x.i): x.line for x in spatial.lines_of(df, ["k"], "y", 4.5).collect()}
    anchors = {k: fold([y for j, _, y in rows if j == k and y is not None], 4.5) for k in {x[0] for x in rows}}
    assert got == {(k, i): None if y is None else max(a for a in anchors[k] if a <= y) for k, i, y in rows}
    assert spatial.lines_of(df.limit(0), ["k"], "y").count() == 0


def test_text_search_by_grams(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abF1") for _ in range(r.randint(0, 6))) for _ in range(300)]
    rows = [(i, r.choice(words), [r.choice(words) for _ in range(r.randint(0, 3))] if i % 9 else None) for i in range(200)] + [(900, None, None), (901, "", [])]
    df = spark.createDataFrame(rows, "k int, name string, words array<string>")
    index = search.gram_index(df, "k", ["name", "words"])
    for q in ("ab", "abF", "ab-f1", "1", "bbbbbbb", "faf"):
        wanted = search.normalised(q)
        want = sorted(k for k, name, ws in rows if wanted in (name or "").upper() or any(wanted in w.upper() for w in ws or []))
        assert sorted(x.k for x in search.text_search(df, index, "k", ["name", "words"], q).collect()) == want


def test_few_rows_are_looked_at(spark, tmp_path):
    """Of 5,000 keys the index names those that have all grams, and a search reads the files with these alone."""
    df = spark.range(5000).select("id", F.concat(F.lit("KEY"), F.lpad("id", 5, "0")).alias("k"))
    path = str(tmp_path / "grams")
    search.gram_index(df, "id", ["k"]).write.parquet(path)
    index = spark.read.parquet(path)
    named = search.containing(index, "id", "Y01234")
    assert [x.id for x in named.collect()] == [1234]
    assert search.containing(index, "id", "KEY").count() == 5000
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


@pytest.mark.parametrize("pool", [1, 2, 4])
def test_blobs_by_runs_equal_the_kernel(spark, pool):
    r = np.random.default_rng(pool)
    masks = {k: r.random((int(r.integers(1, 40)), int(r.integers(1, 40)))) < r.choice([0.2, 0.45, 0.7]) for k in range(25)}
    masks[99] = np.zeros((5, 5), bool)
    lit = [(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    sizes = spark.createDataFrame([(k, m.shape[1], m.shape[0]) for k, m in masks.items()], "img int, width int, height int")
    got = {x.img: (x.x0, x.y0, x.x1, x.y1) for x in raster.blob_boxes(spark.createDataFrame(lit, "img int, y int, x int"), sizes, "img", pool).collect()}
    want = {}
    for k, m in masks.items():
        h, w = m.shape[0], m.shape[1]
        box = raster._blob(m, pool) if h >= pool and w >= pool else None
        if box:
            want[k] = box
    assert {k: b for k, b in got.items() if min(masks[k].shape) >= pool} == want


def test_components(spark):
    r = random.Random(4)
    nodes = [(g, n) for g in ("x", "y") for n in range(120)]
    edges = [(g, r.randrange(120), r.randrange(120)) for g in ("x", "y") for _ in range(80)] + [("x", n, n + 1) for n in range(60, 110)]
    got = {(x.g, x.n): x.component for x in graphs.components(spark.createDataFrame(nodes, "g string, n long"), spark.createDataFrame(edges, "g string, a long, b long"), ["g"], "n").collect()}
    least = {x: x[1] for x in nodes}
    changed = True
    while changed:
        changed = False
        for g, a, b in edges:
            m = min(least[g, a], least[g, b])
            changed |= least[g, a] != m or least[g, b] != m
            least[g, a] = least[g, b] = m
    assert got == least


def test_lists_are_bounded(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(1000)] + [(7, None), (None, 5)], "g int, v long")
    got = {x.g: (x.first, x.n) for x in audit.bounded_list(df, ["g"], "v", 5, "first").collect()}
    assert got == {None: ([5], 1), 0: ([0, 3, 6, 9, 12], 334), 1: ([1, 4, 7, 10, 13], 333), 2: ([2, 5, 8, 11, 14], 333), 7: ([], 0)}
    rows = spark.createDataFrame([(k % 2, k) for k in range(50)], "key int, place int")
    (row,) = audit.unknown_keys(rows, spark.createDataFrame([(0,)], "key int"), "key", "place", most=3).collect()
    assert (row.key, row.places, row.n) == (1, [1, 3, 5], 25)


def test_siblings_are_classes(spark):
    df = spark.createDataFrame([("1", 1), ("1F", 1), ("1L", 1), ("2", 2)], "k string, n int")
    assert sorted(tuple(x) for x in search.tone_siblings(df).collect()) == [("1", 1, 2), ("1F", 1, 2), ("1L", 1, 2), ("2", 2, 0)]
    assert sorted((x[0], x.keys, x[2]) for x in search.tone_classes(df.withColumnRenamed("n", "number"), number="number").collect()) == [(1, ["1", "1F", "1L"], 3), (2, ["2"], 1)]


def test_siblings_are_all_pairs(spark, monkeypatch):
    """Each pair in both directions, as the reference lists them; a null number has none."""
    rows = [(1, 7, "a"), (2, 7, "a"), (3, 7, "b"), (4, 7, "a"), (5, None, "a"), (6, None, "a")]
    df = spark.createDataFrame(rows, "p_partkey long, p_size int, p_brand string")
    monkeypatch.setattr(catalogue_queries, "table", lambda *_: df)
    got = catalogue_queries.tone_siblings(spark, "")
    assert got.columns == ["k", "sibling"]
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2)]


def test_lab_by_steps_is_oklab(spark):
    df = spark.range(0, 256**3, 104_729).select(F.concat(F.lit("#"), F.lpad(F.hex("id"), 6, "0")).alias("hex"), F.lit(1).alias("rgb"), F.lit(2).alias("L"))
    both = color.with_lab(df).select("*", color.oklab(*(color.rgb_of(F.col("hex"))[c] for c in "rgb")).alias("o"))
    for x in both.collect():
        assert (x.L, x.a, x.b) == pytest.approx(tuple(x.o), abs=1e-12) and color.lab_of(x.hex) == pytest.approx(tuple(x.o), abs=1e-12) and x.rgb == 1


def test_counters_need_no_variants(spark):
    from huemill.operators import merge, pages

    colors = spark.createDataFrame([("a",), ("b",)], "key string")
    kept = spark.createDataFrame([("a", 1, 5, "x", True), ("a", 1, 6, "y", True), ("c", 2, 7, "x", True)], "key string, page int, pos int, code string, good boolean")
    docs = merge.color_documents(colors, kept.select("key", "page", "pos", F.lit("l").alias("line"), F.lit("l").alias("printed_as")))
    got = dict(map(tuple, pages.counters(docs, kept, kept.withColumn("good", F.col("pos") > 5)).collect()))
    assert got == {"colors": 2, "appearances": 2, "dropped": 1, "pages": 2, "codes": 2}
