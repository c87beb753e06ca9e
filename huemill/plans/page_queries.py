"""Bundles of published pages: parts are the colours, line items their appearances, suppliers the scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huemill.functions import labels, text
from huemill.operators import bundles, finishes, search
from huemill.plans.catalogue_queries import LAB_SQL, METRICS_SQL, part_colors, part_rgb, table
from huemill.plans.registry import register
from huemill.plans.table_queries import TABLE_SQL, blocks_and_rules

BRAND, BASE, SOURCE, BUCKETS = "B", "https://x.test", "2025版 第1部・第2部", 8

DOCUMENTS_SQL = f"""{LAB_SQL}, {METRICS_SQL[METRICS_SQL.index("unit AS") :]},
per AS (SELECT l_partkey, list_sort(list(DISTINCT l_returnflag)) AS finishes, list_sort(list(DISTINCT l_linenumber::VARCHAR)) AS types, list_sort(list(DISTINCT l_suppkey)) AS pages, list_sort(list(DISTINCT printf('%06d', l_orderkey))) AS codes FROM lineitem GROUP BY l_partkey),
docs AS (SELECT m.p_partkey AS key, m.hex, family, r, g, b, [m.p_brand] AS words, coalesce(finishes, []) AS finishes, coalesce(types, []) AS types, coalesce(pages, []) AS pages, coalesce(codes, []) AS codes,
  string_split(m.p_name, ' ') AS official, list_append(coalesce(finishes, []), string_split(m.p_name, ' ')[1]) AS printed,
  CASE p.p_type WHEN 'ECONOMY' THEN ['丸小ビーズ'] WHEN 'SMALL' THEN ['丸大ビーズ', 'x'] ELSE ['丸小ビーズ', '丸中ビーズ'] END AS categories FROM metrics m JOIN part p USING (p_partkey) LEFT JOIN per ON l_partkey = m.p_partkey),
near AS (SELECT q, string_agg(near::VARCHAR, ',' ORDER BY rank) AS near FROM (SELECT x.p_partkey AS q, y.p_partkey AS near, row_number() OVER (PARTITION BY x.p_partkey ORDER BY round(sqrt((x.L - y.L) ** 2 + (x.A - y.A) ** 2 + (x.B - y.B) ** 2), 9), y.p_partkey) AS rank
  FROM lab x JOIN lab y ON x.p_partkey <> y.p_partkey) WHERE rank <= 10 GROUP BY q),
class AS (SELECT p_brand, list_sort(list(p_partkey)) AS keys FROM part GROUP BY p_brand)"""


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One row per colour, and (key, code)."""
    item = table(spark, sf_dir, "lineitem")
    strings = lambda c: F.array_sort(F.collect_set(c))
    per = item.groupBy(F.col("l_partkey").alias("key")).agg(strings("l_returnflag").alias("finishes"), strings(F.col("l_linenumber").cast("string")).alias("types"), strings("l_suppkey").alias("pages"))
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_type")
    c = part_colors(spark, sf_dir).withColumnRenamed("p_partkey", "key").join(types, "key").join(per, "key", "left")
    none = F.array().cast("array<string>")
    finishes_of, words = F.coalesce("finishes", none), F.split("p_name", " ")
    kinds = lambda *x: F.array(*map(F.lit, x))
    docs = c.select(
        "key", F.col("p_brand").alias("number"), "hex", "family", F.array("p_brand").alias("words"), finishes_of.alias("finishes"), F.coalesce("types", none).alias("types"), F.coalesce("pages", F.array().cast("array<long>")).alias("pages"),
        words.alias("official"), F.array_append(finishes_of, F.get(words, 0)).alias("printed"), F.when(F.col("p_type") == "ECONOMY", kinds("丸小ビーズ")).when(F.col("p_type") == "SMALL", kinds("丸大ビーズ", "x")).otherwise(kinds("丸小ビーズ", "丸中ビーズ")).alias("categories"),
    )
    return docs, item.select(F.col("l_partkey").alias("key"), labels.printed_number(F.col("l_orderkey"), 6).alias("code")).distinct()


def color_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs, codes = documents(spark, sf_dir)
    rgb = part_rgb(spark, sf_dir)
    near = search.nearest_colors(rgb, rgb, 10, key="p_partkey").select(F.col("p_partkey").alias("key"), "rank", "near")
    return bundles.stored({"documents": docs.drop("number"), "codes": bundles.codes_of(codes), "near": near, "siblings": bundles.siblings(docs)}, "key", BUCKETS)


@register("color_pages", f"""WITH {DOCUMENTS_SQL},
said AS (SELECT *, list_filter([
  'BのカラーNo.' || key || '（' || family || '系 ' || hex || ' / ' || array_to_string(words, '・') || '）。',
  CASE WHEN len(finishes) > 0 THEN '仕上げ加工は' || array_to_string(finishes, '・') || '。' END,
  CASE WHEN len(types) > 0 THEN array_to_string(types[:4], '・') || CASE WHEN len(types) > 4 THEN 'ほか計' || len(types) || '種' ELSE '' END || 'で展開。' END,
  CASE WHEN len(codes) > 0 THEN '品番' || array_to_string(codes[:3], '・') || CASE WHEN len(codes) > 3 THEN 'ほか' ELSE '' END || 'の価格つき。' END,
  CASE WHEN len(pages) > 0 THEN 'カタログ P.' || array_to_string(pages, '・') || '掲載。' END], lambda s: s IS NOT NULL) AS ss FROM docs)
SELECT key, family, CASE WHEN (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255 > 0.62 THEN '#1b1a19' ELSE '#ffffff' END AS ink, array_to_string(list_filter(class.keys, lambda k: k <> key)[:20], ',') AS siblings, len(class.keys) - 1 AS n_siblings, near,
  array_to_string(codes[:20], ' ') AS codes, len(codes) AS n_codes, array_to_string(list_filter(official, lambda f: f <> '' AND len(list_filter(printed, lambda p: contains(p, f) OR contains(f, p))) = 0), ',') AS official_only,
  CASE categories[1] || len(categories) WHEN '丸小ビーズ1' THEN '丸小サイズのみの常備品です。' WHEN '丸大ビーズ2' THEN '丸大サイズのみの常備品です。' END AS round_note,
  'B カラーNo.' || key || '｜' || array_to_string(list_append(finishes, family || '系'), '・') AS title, list_reduce(list_prepend('', ss), lambda o, s: CASE WHEN o <> '' AND length(o) + length(s) > 155 THEN o ELSE o || s END) AS description,
  '{{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","position":1,"name":"色を探す","item":"https://x.test/"}},{{"@type":"ListItem","position":2,"name":"カラーNo.' || key || '","item":"https://x.test/colors/' || key || '"}}]}}' AS breadcrumb
FROM said JOIN class ON words[1] = p_brand JOIN near ON q = key""")
def color_pages(spark, sf_dir):
    """The page of every colour."""
    found = bundles.color_pages(color_parts(spark, sf_dir), BRAND, BASE)
    return found.select(
        "key", "family", "ink", F.array_join("siblings", ",").alias("siblings"), "n_siblings", F.array_join("near", ",").alias("near"), F.array_join("codes", " ").alias("codes"), "n_codes",
        F.array_join("official_only", ",").alias("official_only"), "round_note", "title", "description", "breadcrumb",
    )


def scan_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    scans = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("key"), F.concat("l_returnflag", "l_linestatus").alias("line"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    lines, keys = bundles.on_scans(seen)
    return bundles.stored({"scans": search.page_neighbours(scans), "lines": lines, "keys": keys}, "page", BUCKETS)


@register("scan_pages", """WITH a AS (SELECT l_suppkey AS page, l_partkey AS key, l_returnflag || l_linestatus AS line, l_orderkey * 8 + l_linenumber AS pos FROM lineitem),
lines AS (SELECT page, list(line ORDER BY first, line) AS ls FROM (SELECT page, line, min(pos) AS first FROM a GROUP BY page, line) GROUP BY page), keys AS (SELECT page, list_sort(list(DISTINCT key)) AS ks FROM a GROUP BY page),
s AS (SELECT s_suppkey AS page, lag(s_suppkey) OVER (ORDER BY s_suppkey) AS previous, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS next FROM supplier)
SELECT page, previous, next, array_to_string(ls, ',') AS lines, array_to_string(ks[:20], ',') AS keys, len(ks) AS n_keys, '2025版 P.' || page || '｜' || array_to_string(ls[:2], '・') || CASE WHEN len(ls) > 2 THEN 'ほか' ELSE '' END || ' | B' AS title,
  '2025版 第1部・第2部 ' || page || 'ページの誌面。掲載は' || array_to_string(ls, '・') || '。カラーNo.' || array_to_string(ks[:8], '・') || CASE WHEN len(ks) > 8 THEN 'ほか計' || len(ks) || '色' ELSE '' END || 'が載っています。' AS description
FROM s JOIN lines USING (page) JOIN keys USING (page)""")
def scan_pages(spark, sf_dir):
    """Every scanned page."""
    found = bundles.scan_pages(scan_parts(spark, sf_dir), SOURCE, BRAND)
    return found.select("page", "previous", "next", F.array_join("lines", ",").alias("lines"), F.array_join("keys", ",").alias("keys"), "n_keys", "title", "description")


def _guide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = finishes.variations(*blocks_and_rules(spark, sf_dir))
    each = found.select(F.concat_ws("/", "page", "group").alias("finish"), (F.col("page") * 100 + F.col("group")).alias("first"), "place", "name", "numbers", "note")
    types = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_regionkey").cast("string").alias("group"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return bundles.guide(types, each, BRAND)


@register("guide_sections", f"""WITH {TABLE_SQL}
SELECT page || '/' || "group" AS finish, string_agg(name || ' ' || len(codes) || '色', '|' ORDER BY place) AS variations, coalesce(string_agg(name || ': ※' || note, '|' ORDER BY place) FILTER (coalesce(note, '') <> ''), '') AS notes FROM found GROUP BY ALL""")
def guide_sections(spark, sf_dir):
    return _guide(spark, sf_dir)[0].select("finish", F.array_join("variations", "|").alias("variations"), F.array_join("notes", "|").alias("notes"))


@register("guide_description", f"""WITH {TABLE_SQL}, f AS (SELECT DISTINCT page, "group" FROM found)
SELECT (SELECT count(*) FROM f) AS n_finishes, (SELECT count(*) FROM nation) AS n_types, 'Bの仕上げ加工' || (SELECT count(*) FROM f) || '種類（' || (SELECT array_to_string(list(page || '/' || "group" ORDER BY page, "group")[:5], '・') FROM f) || 'ほか）と、'
  || (SELECT array_to_string(list(g ORDER BY k)[:2], '・') FROM (SELECT n_regionkey AS g, min(n_nationkey) AS k FROM nation GROUP BY 1)) || 'など形状' || (SELECT count(*) FROM nation) || '種のサイズ一覧。丸小と丸大の違いや、カラーNo.末尾に付くL・D・Fなど記号の意味も解説します。' AS description""")
def guide_description(spark, sf_dir):
    return _guide(spark, sf_dir)[1]


def _home(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("words"))
    prices = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(labels.printed_number(F.col("l_orderkey"), 6).alias("code"), F.col("l_partkey").alias("color_key"))
    return bundles.home(docs, prices)


@register("home_codes", "SELECT l_partkey AS key, ' ' || array_to_string(list_sort(list(DISTINCT printf('%06d', l_orderkey)))[:20], ' ') || ' ' AS codes FROM lineitem WHERE l_discount > 0.05 GROUP BY l_partkey")
def home_codes(spark, sf_dir):
    return _home(spark, sf_dir)[0]


@register("home_words", """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS k FROM part)
SELECT word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min((p_partkey, k))) AS place FROM w GROUP BY word""")
def home_words(spark, sf_dir):
    """Words by frequency; the place in that order as a column."""
    from pyspark.sql import Window

    found = _home(spark, sf_dir)[1].withColumn("i", F.monotonically_increasing_id())  # a sorted result keeps its order
    return found.select("word", "n", F.row_number().over(Window.orderBy("i")).cast("long").alias("place"))  # of the words of one catalogue


@register("home_counts", """SELECT (SELECT count(*) FROM part) AS colors, count(DISTINCT l_partkey) AS priced, count(DISTINCT l_orderkey) AS codes,
  'Bのグラスビーズ' || (SELECT count(*) FROM part) || '色のカラーチャート。カラーNo.・品番・仕上げ加工25種・ビーズ種別・色の呼び名で絞り込め、選んだ色に近い順にも並べ替えられます。丸小・丸大・特小のサイズ比較と価格・品番つき。' AS description FROM lineitem WHERE l_discount > 0.05""")
def home_counts(spark, sf_dir):
    return _home(spark, sf_dir)[2].withColumn("description", text.home_description(BRAND, F.col("colors"), F.lit(25)))
