import pytest
from pyspark.sql import functions as F

from huemill.operators import bundles
from huemill.plans import page_queries


@pytest.fixture
def by_merge(spark):
    """Joins that Spark may not turn into broadcasts, so that each would show an exchange if it needed one."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    rows = [("1", 1, "#ff0000", "レッド", ["赤"], ["A"], ["t"], [3], ["A", "zz", ""], ["A"], ["丸小ビーズ"]), ("1F", 1, "#00ff00", "グリーン", [], [], [], [], [], [], []), ("9", 9, "#0000ff", "ブルー", [], [], [], [], [], [], ["丸小ビーズ", "丸大ビーズ"])]
    return spark.createDataFrame(rows, "key string, number int, hex string, family string, words array<string>, finishes array<string>, types array<string>, pages array<long>, official array<string>, printed array<string>, categories array<string>")


def test_color_pages_move_no_rows(by_merge):
    spark = by_merge
    docs = documents(spark)
    codes = spark.createDataFrame([("1", "074798"), ("1", "000001"), ("1", "000001"), ("77", "1"), (None, "2")], "key string, code string")
    near = spark.createDataFrame([("1", 2, "9"), ("1", 1, "1F")], "key string, rank int, near string")
    parts = bundles.stored({"documents": docs.drop("number"), "codes": bundles.codes_of(codes), "near": near, "siblings": bundles.siblings(docs)}, "key", 4)
    found = bundles.color_pages(parts, "B", "https://x.test/")
    assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found)
    got = {r.key: r for r in found.collect()}
    assert set(got) == {"1", "1F", "9"}
    one = got["1"]
    assert (one.siblings, one.n_siblings, one.near, one.codes, one.n_codes) == (["1F"], 1, ["1F", "9"], ["000001", "074798"], 2)
    assert (one.official_only, one.round_note, one.ink) == (["zz"], "丸小サイズのみの常備品です。", "#ffffff")
    assert one.description == "BのカラーNo.1（レッド系 #ff0000 / 赤）。仕上げ加工はA。tで展開。品番000001・074798の価格つき。カタログ P.3掲載。"
    assert (got["9"].codes, got["9"].n_siblings, got["9"].near, got["9"].round_note) == ([], 0, None, None)


def test_scan_pages_move_no_rows(by_merge):
    spark = by_merge
    scans = spark.createDataFrame([(1, None, 2), (2, 1, None)], "page int, previous int, next int")
    seen = spark.createDataFrame([(1, "b", "L2", 5), (1, "a", "L1", 7), (1, "a", "L2", 9), (1, None, None, 1), (3, "z", "L", 1)], "page int, key string, line string, pos int")
    lines, keys = bundles.on_scans(seen)
    found = bundles.scan_pages(bundles.stored({"scans": scans, "lines": lines, "keys": keys}, "page", 4), "2025版 第1部", "B")
    assert "Exchange" not in plan(found)
    got = {r.page: r for r in found.collect()}
    assert (got[1].lines, got[1].keys, got[1].n_keys, got[1].title) == (["L2", "L1"], ["a", "b"], 2, "2025版 P.1｜L2・L1 | B")
    assert got[1].description == "2025版 第1部 1ページの誌面。掲載はL2・L1。カラーNo.a・bが載っています。"
    assert (got[2].lines, got[2].keys, got[2].title, got[2].description) == ([], [], "2025版 P.2 | B", "2025版 第1部 2ページの誌面。")


def test_registered_pages_move_no_rows(by_merge):
    parts = page_queries.scan_parts(by_merge, "/root/testdata/sf0.001")
    assert "Exchange" not in plan(bundles.scan_pages(parts, "S", "B"))


def test_home(spark):
    docs = spark.createDataFrame([(0, "1", ["a", "b"]), (1, "2", ["b", "c"]), (2, "3", None)], "pos int, key string, words array<string>")
    prices = spark.createDataFrame([("9", "1"), ("10", "1"), ("9", "1"), ("11", "3"), ("12", None)], "code string, color_key string")
    index, words, counts = bundles.home(docs, prices)
    assert sorted(map(tuple, index.collect())) == [("1", " 10 9 "), ("3", " 11 ")]
    assert [tuple(r) for r in words.collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert tuple(counts.head()) == (3, 2, 4)


def test_many_siblings_are_counted_and_not_listed(spark):
    docs = spark.range(500).select(F.col("id").alias("key"), F.lit(1).alias("number"))
    rows = bundles.siblings(docs).collect()
    assert len(rows) == 500 and {r.n_siblings for r in rows} == {499} and {len(r.siblings) for r in rows} == {bundles.LISTED}
    assert all(r.key not in r.siblings for r in rows)
