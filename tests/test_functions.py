import colorsys
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from huemill import sources
from huemill.functions import color, labels, text
from huemill.operators import audit, consensus, merge, pages, raster, search, spatial
from huemill.sources import sinks


def values(spark, items, made, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in df.select("i", made(F.col("x")).alias("y")).orderBy("i").collect()]


def test_hsv_is_that_of_colorsys(spark):
    rgb = [(r, g, b) for r in range(0, 256, 15) for g in range(0, 256, 17) for b in range(0, 256, 15)]
    df = spark.createDataFrame(rgb, "r int, g int, b int")
    for x in color.with_metrics(df).collect():
        h, s, v = colorsys.rgb_to_hsv(x.r / 255, x.g / 255, x.b / 255)
        assert (x.hex, x.hue) == (f"#{x.r:02x}{x.g:02x}{x.b:02x}", round(h * 360))
        assert abs(x.sat - s) <= 0.0005000001 and x.val == round(v, 3)


def test_families_and_ink(spark):
    df = spark.createDataFrame([(255, 0, 0), (255, 255, 255), (10, 10, 10), (128, 128, 128), (0, 0, 255), (255, 0, 60), (255, 128, 0)], "r int, g int, b int")
    c = [F.col(x) for x in "rgb"]
    assert [x.family for x in color.with_metrics(df).collect()] == ["レッド", "ホワイト", "ブラック", "グレー", "ブルー", "レッド", "オレンジ"]
    assert [x.k for x in df.select(color.contrast_ink(*c).alias("k")).collect()] == ["#ffffff", "#1b1a19", "#ffffff", "#ffffff", "#ffffff", "#ffffff", "#ffffff"]
    assert [tuple(x.t) for x in df.limit(1).select(color.rgb_of(F.lit("#0a10ff")).alias("t")).collect()] == [(10, 16, 255)]


def test_labels(spark):
    cases = {"M171": ("M", 171, "", "171"), "PF5021": ("PF", 5021, "", "5021"), "0-3201": ("α", 3201, "", "3201"), "PF551・022213220": ("PF", 551, "", "551"), "3L": (None, 3, "L", "3L"), "162c": (None, 162, "C", "162C"), "特小CHS 221": ("CHS", 221, "", "221"), "CR-PF12": ("CR PF", 12, "", "12"), "1O2": (None, 102, "", "102"), "４６L": (None, 46, "L", "46L"), "5S1": (None, 551, "", "551")}
    cases |= dict.fromkeys(["5MM", "2021", "S", "0", "123M", "", "000", "abc", "12345"], None)
    got = values(spark, list(cases), labels.parse_label)
    assert [x and (x.prefix, x.number, x.suffix, x.key) for x in got] == list(cases.values())
    loose = values(spark, ["bead 5mm M171", "a b c d 12", "see 2021", "M171"], labels.parse_label_loose)
    assert [x and x.key for x in loose] == ["171", None, None, "171"]


def test_codes_and_tokens(spark):
    got = values(spark, ["1202,12031204，1205、46l.９x ※1=2", "pf12 1O", "1234567", ""], labels.split_codes)
    assert [(x.codes, x.rejected) for x in got][0] == (["1202", "1203", "1204", "1205", "46L"], ["12031204→1203,1204", "９X"])
    assert [x.codes for x in got[1:]] == [["PF12", "10"], [], []]
    kinds = values(spark, ["1,180円", "074798", "4964291-123456", "約6.5g入", "糸通し", "糸通し2", "x"], labels.classify_token)
    assert [x and (x.kind, x.value) for x in kinds] == [("price", "1180"), ("productCode", "074798"), ("jan", "4964291123456"), ("quantity", "約6.5g入"), ("style", "糸通し"), None, None]
    parts = values(spark, ["ab 180 円 c"], lambda t: labels.tokens_of(t, F.lit(0.0), F.lit(9.0)))[0]
    assert [p.token for p in parts] == ["ab", "180円", "c"] and parts[1].x0 == 9.0 * 3 / 9
    assert values(spark, ["「a」「b」", "x", "「」"], labels.bracketed) == [["a", "b"], [], [""]]
    assert values(spark, ["a※ b ※c", "a"], labels.note_text) == ["b；c", None]
    assert [tuple(x) for x in values(spark, ["①PFオーロラの", "x"], labels.clean_variation)] == [("PFオーロラ", ["オーロラ", "PF"]), ("x", [])]
    assert values(spark, [["a1", "2b"], ["砡", "x"], []], labels.prose_text, "array<string>") == ["a1・2b", "艶x", ""]
    assert values(spark, ["2.0〜2.2", "x", "3", "", "1~x"], labels.size_mm) == [2.1, 0.0, 3.0, 0.0, 0.0]
    assert values(spark, ["1660", "5"], lambda c: labels.fixed_up(c, {"1660": "166C"})) == ["166C", "5"]
    assert values(spark, ["a/b.jpg"], labels.served_name) == ["a/b.webp"]
    assert values(spark, ["AF", "U", ""], labels.tone_label) == ["淡い", None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), max_size=6), min_size=20, max_size=40))
def test_fitted_sentences(spark, lists):
    def loop(items):
        out = ""
        for s in items:
            if not out or len(out) + len(s) <= 40:
                out += s
        return out

    assert values(spark, lists, lambda x: text.fit_sentences(x, 40), "array<string>") == [loop(x) for x in lists]


def test_published_text(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    c = {"key": F.lit("46L"), "family": F.lit("レッド"), "hex": F.lit("#ff0000"), "words": arr("赤"), "finishes": arr("A", "B", "A"), "series": F.lit(None).cast("string"), "types": arr("1", "2", "3", "4", "5"), "codes": arr(), "span": F.lit(None).cast("string"), "pages": F.array(F.lit(3), F.lit(9))}
    row = one.select(
        text.description("X", c).alias("d"), text.title("X", c["key"], c["family"], c["finishes"], c["series"]).alias("t"), text.head_list(c["types"], 3).alias("h"), text.address("https://x.y/", F.lit("a b"), F.lit("é")).alias("u"),
        text.json_ld("Product", {"name": F.lit("a<b"), "sku": F.lit(None).cast("string")}).alias("j"), text.thousands(F.lit(12345)).alias("n"), text.first_word(F.lit("ab cd")).alias("w"), text.round_note(arr("丸小ビーズ", "x")).alias("r"), text.official_only(arr("", "ab", "zz"), arr("abc")).alias("o"),
        text.page_metadata(F.lit("t"), F.lit("d"), F.lit("u"), F.lit("i")).alias("m"), color.drawn_height(F.lit(2.0), F.lit(40), F.lit("丸小")).alias("px"),
    ).first()
    assert row.d == "XのカラーNo.46L（レッド系 #ff0000 / 赤）。仕上げ加工はA・B。1・2・3・4ほか計5種で展開。カタログ P.3・9掲載。"
    assert (row.t, row.h, row.u) == ("X カラーNo.46L｜A・B・レッド系", "1・2・3ほか", "https://x.y/a%20b/%C3%A9")
    assert row.j == '{"@context":"https://schema.org","@type":"Product","name":"a\\u003cb"}'
    assert (row.n, row.w, row.r, row.o, row.m.card.url, row.px) == ("12,345", "ab", "丸小サイズのみの常備品です。", ["zz"], "u", 50)


def test_line_fold_goes_by_the_first_of_the_line(spark):
    ys = [0.0, 3.0, 5.0, 7.0, 9.4, 9.6, 20.0]
    df = spark.createDataFrame([(1, y) for y in ys], "k int, y double")
    got = {r.y: r.line for r in spatial.lines_of(df, ["k"], "y").collect()}
    assert got == {0.0: 0.0, 3.0: 0.0, 5.0: 5.0, 7.0: 5.0, 9.4: 5.0, 9.6: 9.6, 20.0: 20.0}


def test_layout(spark):
    xs = spark.createDataFrame([(1, x) for x in (10.0, 11.0, 50.0, 90.0, 91.0)] + [(2, 5.0), (2, 70.0)], "page int, x double")
    assert sorted(map(tuple, spatial.column_edges(xs, "page", "x", F.lit(3.0)).collect())) == [(1, 10.0), (1, 90.0), (2, 5.0)]
    cells = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.0, 10.0), (1, 1, 20.0, 30.0, 0.0, 10.0)], "page int, cell_id int, bx0 double, bx1 double, by0 double, by1 double")
    tokens = spark.createDataFrame([(1, 0, "price", 14.0, 16.0, 12.0), (1, 1, "jan", 90.0, 99.0, 12.0), (1, 2, "style", 90.0, 99.0, 12.0)], "page int, token_id int, kind string, x0 double, x1 double, cy double")
    met, orphans = spatial.tokens_to_cells(tokens, cells)
    assert [(r.token_id, r.cell_id) for r in met.collect()] == [(0, 0)] and [r.token_id for r in orphans.collect()] == [2]
    rects = spark.createDataFrame([(1, i, 20.0 * i, 20.0 * i + 15, 0.0, 15.0) for i in range(4)], "page int, rect_id int, rx0 double, rx1 double, ry0 double, ry1 double")
    caps = spark.createDataFrame([(1, 0, 0.0, 10.0, 18.0, 22.0), (1, 1, 60.0, 70.0, 18.0, 22.0)], "page int, caption_id int, cx0 double, cx1 double, cy0 double, cy1 double")
    assert {r.rect_id: r.caption_id for r in spatial.photos_to_captions(rects, caps).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    isl = spatial.islands(spark.createDataFrame([(1, 0, "a", 0.0, 5.0), (1, 1, "a", 6.0, 9.0), (1, 2, "b", 20.0, 25.0)], "p int, i int, k string, top double, bottom double"), ["p"], ["i"], "k")
    assert [(r.island, r.ceiling) for r in spatial.ceilings(isl, ["p"], "island", "top", "bottom").orderBy("island").collect()] == [(1, 0.0), (2, 11.0)]
    blocks = spark.createDataFrame([(1, 0, "b", 5.0, 5.0), (1, 1, "a", 1.0, 5.0), (1, 2, "z", 50.0, 5.0)], "page int, block_id int, text string, cx double, cy double")
    grid = spark.createDataFrame([(1, 9, 0.0, 10.0, 0.0, 5.0)], "page int, cell_id int, x0 double, x1 double, y0 double, y1 double")
    assert [r.text for r in spatial.cell_text(blocks, grid, "-").collect()] == ["a-b"]
    near = spatial.first_of_near(spark.createDataFrame([(1, 0, 3.9, "x"), (1, 1, 4.1, "y"), (1, 2, 9.0, "z")], "p int, i int, y double, v string"), ["p"], {"y": 4.0}, ["i"])
    assert sorted(r.v for r in near.collect()) == ["x", "z"]


def test_merging(spark):
    v = spark.createDataFrame([(0, "1", "k", "l", "", "q", 5, 1, "s"), (1, "1", "k", "l", "t", "q", 6, 1, "s"), (2, None, "k", "l", "t", "q", 7, 1, "s"), (3, "2", "k", "l", "", "q", None, 1, "s")], "pos int, code string, color_key string, line string, style string, quantity string, price int, page int, sales_style string")
    assert [(r.code, r.style, r.price) for r in merge.price_seed(v).collect()] == [("1", "t", 6), ("2", "s", None)]
    lists = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x")], "key string, ord int, v string")
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert {r.key: [s.v for s in r.l] for r in merge.lookup_lists(keys, lists, "key", "l", ["v"], ["ord"]).collect()} == {"a": ["x", "y"], "b": []}
    items = spark.createDataFrame([("a", 3), ("q", 4)], "base string, number int")
    colors = spark.createDataFrame([("a", ["f"])], "key string, finishes array<string>")
    assert {r.base: (r.number, r.finishes, r.words) for r in merge.recycled_line(items, colors).collect()} == {"a": (5003, ["f"], []), "q": (5004, [], [])}
    one = spark.createDataFrame([([("b", 1), ("a", 2), ("p", 3)],)], "s array<struct<category:string,v:int>>")
    assert one.select(merge.preferred_shape(F.col("s"), ["p"]).alias("x")).first().x.v == 3
    assert one.select(merge.preferred_shape(F.col("s"), ["zz"]).alias("x")).first().x.v == 2
    assert merge.with_names(keys, spark.createDataFrame([("a", "A")], "key string, name string"), "key", "name").orderBy("key").collect()[1].name == "b"
    assert spark.range(1).select(merge.mapped(F.array(F.lit("x"), F.lit("y")), {"x": "1"}).alias("m")).first().m == ["1"]
    app = spark.createDataFrame([("a", 2, 0, "p", "l"), ("a", 1, 1, "p", "l")], "key string, page int, pos int, printed_as string, line string")
    var = spark.createDataFrame([("a", 2, 0, 0, "s", 5, "c", "q")], "key string, page int, pos int, vpos int, style string, price int, code string, quantity string")
    doc = {r.key: r.appearances for r in merge.color_documents(keys, app, var).collect()}
    assert [(x.page, len(x.variants)) for x in doc["a"]] == [(1, 0), (2, 1)] and doc["b"] == []


def test_search_state_and_pages(spark):
    s = search.SearchSpec().more().toggled("fam", "x")
    assert (s.limit, s.active(), s.toggled("fam", "x").active(), s.picking("#000000").limit) == (240, 1, 0, 120)
    rows = [("46", 46, "", "#ff0000", 0, 1.0, 1.0, "R", ["スキ"], ["w"], False, ["000046"]), ("46L", 46, "L", "#00ff00", 120, 1.0, 1.0, "G", ["b"], ["赤"], True, []), ("PF5021", 5021, "", "#0000ff", 240, 0.5, 0.5, "B", [], [], False, ["123456"]), ("146", 146, "", "#fe0000", 0, 0.9, 1.0, "R", [], [], False, [])]
    index = spark.createDataFrame(rows, "k string, n int, s string, hex string, hue int, sat double, val double, fam string, f array<string>, w array<string>, matte boolean, codes array<string>")
    find = lambda **kw: [r.k for r in search.search(index, search.SearchSpec(**kw), codes="codes").collect()]
    assert find(query="46") == ["46", "46L"] and find(query="46l") == ["46L"] and find(query="5021") == ["PF5021"]
    assert find(query="123456") == ["PF5021"] and find(query="スキ") == ["46"] and find(query="pf") == ["PF5021"] and find(query="赤") == ["46L"]
    assert find(picked="#ff0000")[:2] == ["46", "146"] and find(sort="hue")[0] == "46" and find(matte_only=True) == ["46L"]
    assert find(facets={"fam": frozenset("RG")}, limit=2) == ["46", "46L"]


def test_nearest_colors_is_complete(spark):
    r = np.random.default_rng(3)
    rgb = [(int(i), *map(int, r.integers(0, 256, 3))) for i in range(150)] + [(200, 1, 1, 1), (201, 1, 1, 1)]
    df = spark.createDataFrame(rgb, "k int, r int, g int, b int")
    lab = {x.k: x.c for x in df.select("k", color.oklab(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect()}
    got = {(x.k, x.rank): x.near for x in search.nearest_colors(df, df, 5).collect()}
    for k in lab:
        order = sorted((round(math.dist(lab[k], lab[o]), 9), o) for o in lab if o != k)
        assert [got[k, i + 1] for i in range(5)] == [o for _, o in order[:5]]


def test_raster(spark):
    px = [("a", y, x, *((200, 10, 10) if 2 <= x < 6 and 1 <= y < 5 else (255, 255, 255))) for y in range(6) for x in range(8)]
    df = spark.createDataFrame(px, "img string, y int, x int, r int, g int, b int")
    ground = raster.background(df)
    assert tuple(ground.first())[1:] == (248, 248, 248)
    mask = raster.foreground(df, ground)
    assert mask.count() == 16 and tuple(raster.representative_color(df, mask).first())[1:] == (200, 10, 10)
    m = np.zeros((8, 8), bool)
    m[0:2, 0:2] = m[4:8, 2:7] = True
    boxes = raster.blob_bounds(spark.createDataFrame([("i", 8, 8, m.reshape(-1).tolist()), ("e", 8, 8, [False] * 64)], "img string, height int, width int, mask array<boolean>"), pool=2)
    assert [tuple(x) for x in boxes.collect()] == [("i", 2, 4, 7, 8)]
    fill = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 0.5, 0.95, 0.2, 1.0])] + [("b", 0, 1.0)], "k string, i int, s double")
    assert {x.k: (x.first, x.last) for x in raster.edge_peel(fill, "k", "i", "s").collect()}["b"] == (0, 0)
    best = raster.best_region(spark.createDataFrame([(1, 0, 0.5, 90.0), (1, 1, 0.0, 10.0), (1, 2, 0.01, 20.0)], "c int, ord int, overlap double, area double"), ["c"])
    assert best.first().ord == 2
    assert raster.pooled(df, 2, 1).count() == 2
    kept = consensus.without_ground(df, ["img"], ["r", "g", "b"])
    assert kept.count() == 16


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p03.json").write_text('[{"t":"a","conf":1,"x":0.1,"y":0.5,"w":0.2,"h":0.1}]')
    pages = spark.createDataFrame([(3, 100.0, 200.0)], "page int, width double, height double")
    b = sources.ocr_blocks(spark, str(tmp_path / "p*.json"), pages).first()
    assert (b.page, b.block_id, b.text, b.x0, b.y0) == (3, 0, "a", 10.0, 100.0)
    (tmp_path / "i.json").write_text('{"item":[{"c_n":"1","c":"「赤」「青」"},{"c_n":"2"}]}')
    assert [(r.pos, r.c_n) for r in sources.product_index(spark, str(tmp_path / "i.json")).collect()] == [(0, "1"), (1, "2")]
    (tmp_path / "prices.json").write_text('{"074798":{"colorKey":"1","price":5}}')
    assert [(r.code, r.price) for r in sources.price_map(spark, str(tmp_path / "prices.json")).collect()] == [("074798", 5)]
    assert sources.optional(spark, str(tmp_path / "none.json"), "a int").count() == 0
    for n in (2, 10):
        (tmp_path / f"p{n}.webp").write_bytes(b"x")
    assert [r.page for r in sources.rendered_pages(spark, str(tmp_path)).collect()] == [2, 10]
    shapes = spark.createDataFrame([(1, 0.0, 5.04, 90.0, 5.06), (1, 0.0, 5.04, 90.0, 5.06), (1, 3.0, 0.0, 3.0, 30.0), (1, 0.0, 0.0, 9.0, 9.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.orient for r in sources.rules(shapes).collect()) == ["h", "v"]
    assert sources.swatch_rects(shapes, pages.withColumn("page", F.lit(1))).count() == 1
    x = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (299).to_bytes(3, "little") + (149).to_bytes(3, "little") + bytes(4)
    lossless = b"RIFF\0\0\0\0WEBPVP8L" + bytes(5) + (49 | 29 << 14).to_bytes(4, "little") + bytes(8)
    lossy = b"RIFF\0\0\0\0WEBPVP8 " + bytes(10) + (640).to_bytes(2, "little") + (480).to_bytes(2, "little") + bytes(4)
    got = values(spark, [x, lossless, lossy, b"nope", x[:20]], sources.webp_size, "binary")
    assert [g and tuple(g) for g in got] == [(300, 150), (50, 30), (640, 480), None, None]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.write_documents(df, str(tmp_path / "docs"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "docs")).collect()) == ['{"k":1,"v":"a"}', '{"k":2}']
    for price, reseed, want in ((1, False, 1), (2, False, 1), (3, True, 3)):
        sinks.write_prices(spark.createDataFrame([(price,)], "p int"), str(tmp_path / "seed"), str(tmp_path / "live"), reseed)
        assert spark.read.json(str(tmp_path / "live")).first().p == want and spark.read.json(str(tmp_path / "seed")).first().p == price
    sinks.write_report(spark.range(9), str(tmp_path / "rep"), ["id"], rows=4)
    assert spark.read.json(str(tmp_path / "rep")).count() == 4


def test_audits(spark):
    mine = spark.createDataFrame([("a", ["PF着色"]), ("b", ["x"]), ("c", []), ("d", ["PF"])], "key string, names array<string>")
    theirs = spark.createDataFrame([("a", ["PF加工", "着色加工"]), ("b", ["y"]), ("c", ["z"])], "key string, terms array<string>")
    out = audit.agreement(mine, theirs, "key", {"PF": ["PF"], "着色": ["着色"]})
    assert {r.key: r.outcome for r in out.collect()} == {"a": "agree", "b": "disagree", "c": "only_theirs", "d": "only_mine"}
    rate = audit.agreement_rate(out).first()
    assert (rate.agree, rate.disagree, rate.percent) == (1, 1, 50.0)
    assert audit.agreement_rate(out.limit(0)).first().percent == 0.0
    assert [(r.names, r.n) for r in audit.unmapped(out).collect()] == [("x", 1)]
    sheet = audit.proof_sheet(spark.createDataFrame([(1, n) for n in "abc"], "page int, name string"), "page", "name", 2)
    assert [(r.column, r.row) for r in sheet.orderBy("name").collect()] == [(0, 0), (0, 1), (1, 0)]
    files = audit.pruned_files(spark.createDataFrame([("a.txt", 3), ("b.html", 5)], "path string, length long"), r"\.txt$")
    assert {r.pruned: (r.files, r.bytes) for r in files.collect()} == {True: (1, 3), False: (1, 5)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), min_size=1, max_size=9), min_size=10, max_size=30))
def test_upper_median(spark, lists):
    df = spark.createDataFrame([(i, v) for i, x in enumerate(lists) for v in x], "k int, v int")
    got = {r.k: r.m for r in df.groupBy("k").agg(consensus.upper_median("v").alias("m")).collect()}
    assert got == {i: sorted(x)[len(x) // 2] for i, x in enumerate(lists)}




def test_blob_against_flood_fill():
    r = np.random.default_rng(11)
    for _ in range(200):
        pool = int(r.integers(1, 4))
        h, w = int(r.integers(pool, 14)), int(r.integers(pool, 14))
        mask = r.random((h, w)) < r.choice([0.1, 0.3, 0.5])
        rows, cols = h // pool, w // pool
        cells = {(i, j) for i in range(rows) for j in range(cols) if mask[i * pool : (i + 1) * pool, j * pool : (j + 1) * pool].any()}
        blobs, left = [], set(cells)
        while left:
            todo, blob = [left.pop()], set()
            while todo:
                i, j = todo.pop()
                blob.add((i, j))
                near = {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)} & left
                left -= near
                todo += near
            blobs.append(blob)
        want = None
        if blobs:
            best = min(blobs, key=lambda b: (-len(b), max(i * cols + j for i, j in b)))
            y0, y1 = min(i for i, _ in best) * pool, (max(i for i, _ in best) + 1) * pool
            x0, x1 = min(j for _, j in best) * pool, (max(j for _, j in best) + 1) * pool
            lit = [(y, x) for y in range(y0, y1) for x in range(x0, x1) if mask[y, x]]
            want = (min(x for _, x in lit), min(y for y, _ in lit), max(x for _, x in lit) + 1, max(y for y, _ in lit) + 1)
        assert raster._blob(mask, pool) == want


def test_trim(spark):
    px = []
    for y in range(20):
        for x in range(30):
            strip = 8 <= y < 14 and 5 <= x < 25 and (x + y) % 3 > 0
            mark = y < 3 and x < 3
            px.append(("a", y, x, *((10, 120, 30) if strip or mark else (255, 255, 255))))
    px += [("b", y, x, 255, 255, 255) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(px, "img string, y int, x int, r int, g int, b int").repartition(3)
    rects = spark.createDataFrame([("a", 100.0, 50.0, 160.0, 90.0), ("b", 0.0, 0.0, 1.0, 1.0)], "img string, x0 double, y0 double, x1 double, y1 double")
    (row,) = pages.trim(df, rects).collect()
    lit = [(y, x) for _, y, x, *c in px[:600] if c[0] == 10 and y >= 3]
    want = (100 + 2 * min(x for _, x in lit) - 0.6, 50 + 2 * min(y for y, _ in lit) - 0.6, 100 + 2 * (max(x for _, x in lit) + 1) + 0.6, 50 + 2 * (max(y for y, _ in lit) + 1) + 0.6)
    assert np.allclose(tuple(row)[1:], want)


def test_asof_reach(spark):
    left = spark.createDataFrame([(1, 1, 10.0), (1, 2, 4.0), (1, 3, 30.0), (2, 4, 5.0)], "page int, id int, x double")
    edges = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 12.0), (1, 12.0)], "page int, edge double")
    got = lambda **kw: {r.id: r.edge for r in spatial.asof(left, edges, ["page"], "x", "edge", **kw).collect()}
    assert got() == {1: 10.0, 2: None, 3: 12.0, 4: None}
    assert got(reach=15.0) == {1: 10.0, 2: None, 3: None, 4: None}
    assert got(forward=True) == {1: 12.0, 2: 5.0, 3: None, 4: None}
    assert got(gap=1.0) == {1: 10.0, 2: 5.0, 3: 12.0, 4: None} and got(forward=True, gap=1.0) == {1: 12.0, 2: 10.0, 3: None, 4: None}


def test_pages(spark):
    pages_ = spark.createDataFrame([(1, 0.0, 500.0, 800.0, 60.0)], "page int, left double, right double, bottom double, var double")
    rules = spark.createDataFrame([(1, "h", 100.0, 5.0, 490.0), (1, "h", 200.0, 55.0, 490.0), (1, "h", 300.0, 3.0, 495.0), (1, "h", 350.0, 200.0, 495.0), (1, "v", 60.0, 0.0, 700.0)], "page int, orient string, pos double, a double, b double")
    assert [tuple(x) for x in pages.finish_grid(rules, pages_).orderBy("low").collect()] == [(1, 100.0, 200.0, 1), (1, 200.0, 300.0, 1), (1, 300.0, 800.0, 2)]
    groups = spark.createDataFrame([(1, 10.0, 50.0, 100.0), (1, 10.0, 5.0, 1.0)], "page int, col double, top double, pitch double")
    assert [(x.px0, x.py0, x.px1, x.py1) for x in pages.probes(groups).collect()] == [(5.0, 33.0, 65.0, 49.5)]
    named = spark.createDataFrame([("a.jpg", 1), ("b.x.png", 2)], "image string, n int")
    files = spark.createDataFrame([("b.x.webp",)], "name string")
    assert [(x.n, x.served) for x in pages.served(named, files).collect()] == [(2, "b.x.webp")]
    assert [x.v for x in spark.range(1).select(pages.to_pixels(F.lit(2.5), 72).alias("v")).collect()] == [2]
    kept = pages.on_chart_pages(spark.createDataFrame([(1, "a"), (2, "b")], "page int, t string"), pages_.select("page", "var")).collect()
    assert [(x.page, x.t, x["var"]) for x in kept] == [(1, "a", 60.0)]
    ok = spark.createDataFrame([("x",)], "c string")
    assert ok.select(pages.strictly_mapped(F.col("c"), {"x": "y"}).alias("m")).first().m == "y"
    with pytest.raises(Exception, match="no entry for x"):
        ok.select(pages.strictly_mapped(F.col("c"), {"z": "y"}).alias("m")).collect()
    shown = spark.createDataFrame([("b", "#1", 2, "R", 0), ("a", "#2", 3, "G", 1)], "key string, hex string, hue int, family string, extra int")
    assert pages.chips(shown).columns == ["key", "hex", "hue", "family"] and [x.key for x in pages.keys_of(shown, "key").collect()] == ["a", "b"]


def test_structured_data(spark):
    df = spark.createDataFrame([("46", "R", "#ff0000", ["x", "x", "y"], ["t"], ["000046"], [("丸小", "2.2")], None), ("47", "G", "#00ff00", [], [], [], [], "i.webp")], "key string, family string, hex string, finishes array<string>, types array<string>, codes array<string>, shapes array<struct<category:string,size:string>>, image string")
    c = {k: F.col(k) for k in df.columns} | {"url": F.concat(F.lit("https://x.test/colors/"), F.col("key")), "name": F.concat(F.lit("No."), F.col("key")), "description": F.lit("a < b")}
    labels_ = {k: k.upper() for k in ("key", "family", "hex", "finishes", "types", "codes")}
    rows = [x.j for x in df.select(text.product(c, "brand", labels_).alias("j"), "key").orderBy("key").collect()]
    one, two = map(json.loads, rows)
    assert "<" not in rows[0] and one["description"] == "a < b" and one["sku"] == "000046" and "image" not in one and two["image"] == "i.webp" and "sku" not in two
    assert [(p["name"], p["value"]) for p in one["additionalProperty"]] == [("KEY", "46"), ("FAMILY", "R"), ("HEX", "#ff0000"), ("FINISHES", "x・y"), ("TYPES", "t"), ("CODES", "000046"), ("丸小", "外径約2.2mm")]
    assert [p["name"] for p in two["additionalProperty"]] == ["KEY", "FAMILY", "HEX"]
    items = F.array(F.struct(F.lit("a").alias("name"), F.lit("u").alias("url")), F.struct(F.lit("b").alias("name"), F.lit("v").alias("url")))
    page = json.loads(df.limit(1).select(text.collection_page("https://x.test", F.lit("p"), F.lit("n"), F.lit("t"), F.lit("i"), items).alias("j")).first().j)
    assert page["mainEntity"]["numberOfItems"] == 2 and page["mainEntity"]["itemListElement"][1] == {"@type": "ListItem", "position": 2, "name": "b", "url": "v"}
    trail = json.loads(df.limit(1).select(text.breadcrumb([(F.lit("a"), F.lit("u")), (F.lit("b"), F.lit("v"))]).alias("j")).first().j)
    assert [x["position"] for x in trail["itemListElement"]] == [1, 2]
    site = json.loads(df.limit(1).select(text.website("https://x.test/", "n", F.lit("t"), "brand").alias("j")).first().j)
    assert site["@id"] == "https://x.test/#website" and site["about"]["name"] == "brand"


def test_documents_and_dimensions(spark, tmp_path):
    docs = spark.createDataFrame([(2, "L", [1, 2]), (1, "", [])], "number int, suffix string, pages array<int>")
    sinks.write_colors(docs, str(tmp_path / "colors"))
    back = sources.documents(spark, str(tmp_path / "colors"), "number int, suffix string, pages array<int>")
    assert [tuple(x) for x in back.orderBy("number").collect()] == [(1, "", []), (2, "L", [1, 2])]
    (tmp_path / "types.csv").write_text("code,name\n01,丸小\n")
    assert [tuple(x) for x in sources.dimension(spark, str(tmp_path / "types.csv"), "code string, name string").collect()] == [("01", "丸小")]
