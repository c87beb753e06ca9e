"""Queries of the catalogue engine over the driver's tables: each operator on real rows, with the SQL of the same result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huemill import sources
from huemill.functions import color, labels, text
from huemill.operators import audit, consensus, merge, raster, search, spatial
from huemill.plans.registry import register
from huemill.session import materialised, shared_folder
from huemill.sources import sinks

PICKED = "#3c78b4"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- colours: every part gets a fixed RGB from its key and size ---------------------------------

RGB_SQL = "rgb AS (SELECT p_partkey, p_size, p_brand, p_name, (p_partkey * 37) % 256 AS r, (p_partkey * 91 + p_size * 7) % 256 AS g, (p_size * 53 + p_partkey * 13) % 256 AS b FROM part)"
METRICS_SQL = (
    RGB_SQL
    + """,
unit AS (SELECT *, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z FROM rgb),
ext AS (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo FROM unit),
parts AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / hi END AS s, (hi - x) / nullif(hi - lo, 0) AS rc, (hi - y) / nullif(hi - lo, 0) AS gc, (hi - z) / nullif(hi - lo, 0) AS bc FROM ext),
turned AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN x = hi THEN (bc - gc) / 6 WHEN y = hi THEN (2 + rc - bc) / 6 ELSE (4 + gc - rc) / 6 END AS t FROM parts),
hsv AS (SELECT *, (t - floor(t)) * 360 AS h FROM turned),
metrics AS (SELECT p_partkey, p_size, p_brand, p_name, r, g, b, printf('#%02x%02x%02x', r, g, b) AS hex, round_even(h, 0)::INT AS hue, round_even(s, 3) AS sat, round_even(hi, 3) AS val,
  CASE WHEN s < 0.12 THEN CASE WHEN hi > 0.82 THEN 'ホワイト' WHEN hi < 0.25 THEN 'ブラック' ELSE 'グレー' END
       WHEN h < 10 OR h >= 345 THEN 'レッド' WHEN h < 45 THEN 'オレンジ' WHEN h < 70 THEN 'イエロー' WHEN h < 160 THEN 'グリーン' WHEN h < 250 THEN 'ブルー' WHEN h < 290 THEN 'パープル' ELSE 'ピンク' END AS family FROM hsv)"""
)
LINEAR = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
LAB_SQL = f"""{RGB_SQL},
lin AS (SELECT p_partkey, p_brand, p_size, {LINEAR.format(c="r")} AS x, {LINEAR.format(c="g")} AS y, {LINEAR.format(c="b")} AS z FROM rgb),
lms AS (SELECT p_partkey, p_brand, p_size, cbrt(0.4122214708 * x + 0.5363325363 * y + 0.0514459929 * z) AS l, cbrt(0.2119034982 * x + 0.6806995451 * y + 0.1073969566 * z) AS m, cbrt(0.0883024619 * x + 0.2817188376 * y + 0.6299787005 * z) AS s FROM lin),
lab AS (SELECT p_partkey, p_brand, p_size, 0.2104542553 * l + 0.793617785 * m - 0.0040720468 * s AS L, 1.9779984951 * l - 2.428592205 * m + 0.4505937099 * s AS A, 0.0259040371 * l + 0.7827717662 * m - 0.808675766 * s AS B FROM lms)"""


def part_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_name")
    return part.withColumns({"r": (k * 37) % 256, "g": (k * 91 + s * 7) % 256, "b": (s * 53 + k * 13) % 256})


def part_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color.with_metrics(part_rgb(spark, sf_dir))


@register("color_metrics", f"WITH {METRICS_SQL} SELECT p_partkey, hex, hue, sat, val, family FROM metrics")
def color_metrics(spark, sf_dir):
    return part_colors(spark, sf_dir).select("p_partkey", "hex", "hue", "sat", "val", "family")


@register("family_counts", f"WITH {METRICS_SQL} SELECT family, count(*) AS n FROM metrics GROUP BY family")
def family_counts(spark, sf_dir):
    return part_colors(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"))


@register("oklab", f"WITH {LAB_SQL} SELECT p_partkey, round(L, 9) AS l, round(A, 9) AS a, round(B, 9) AS b FROM lab")
def oklab(spark, sf_dir):
    lab = part_rgb(spark, sf_dir).select("p_partkey", color.oklab(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    return lab.select("p_partkey", F.round("c.L", 9).alias("l"), F.round("c.a", 9).alias("a"), F.round("c.b", 9).alias("b"))


@register("nearest_to_picked", f"""WITH {LAB_SQL.replace("FROM part)", "FROM part UNION ALL SELECT -1, 0, '', '', 60, 120, 180)")}
SELECT x.p_partkey, round(sqrt((x.L - p.L) ** 2 + (x.A - p.A) ** 2 + (x.B - p.B) ** 2), 9) AS distance FROM lab x, lab p WHERE p.p_partkey = -1 AND x.p_partkey > 0 ORDER BY distance, x.p_partkey LIMIT 10""")
def nearest_to_picked(spark, sf_dir):
    rgb = part_rgb(spark, sf_dir)
    index = rgb.select("p_partkey", color.hex_of(*map(F.col, "rgb")).alias("hex"))
    spec = replace(search.SearchSpec().picking(PICKED), limit=10)
    return search.search(index, spec, position="p_partkey").select("p_partkey", "distance")


@register("nearest_self_topk", f"""WITH {LAB_SQL}
SELECT q AS p_partkey, near, rank FROM (SELECT x.p_partkey AS q, y.p_partkey AS near, row_number() OVER (PARTITION BY x.p_partkey ORDER BY round(sqrt((x.L - y.L) ** 2 + (x.A - y.A) ** 2 + (x.B - y.B) ** 2), 9), y.p_partkey) AS rank
FROM lab x JOIN lab y ON x.p_partkey <> y.p_partkey) WHERE rank <= 10""")
def nearest_self_topk(spark, sf_dir):
    rgb = part_rgb(spark, sf_dir)
    return search.nearest_colors(rgb, rgb, 10, key="p_partkey").select("p_partkey", "near", F.col("rank").cast("long").alias("rank"))


def _ordered(spark, sf_dir, sort: str) -> DataFrame:
    c = part_colors(spark, sf_dir).withColumns({"k": F.col("p_partkey"), "n": F.col("p_size"), "s": F.col("p_brand")})
    top = search.search(c, search.SearchSpec(sort=sort))
    place = Window.orderBy(*search.ordering(search.SearchSpec(sort=sort)))  # over one page
    return top.select("p_partkey", F.row_number().over(place).cast("long").alias("place"))


def _order_sql(by: str) -> str:
    return f"WITH {METRICS_SQL} SELECT p_partkey, row_number() OVER (ORDER BY {by}, p_partkey) AS place FROM metrics QUALIFY place <= 240"


@register("order_hue", _order_sql("hue, sat DESC"))
def order_hue(spark, sf_dir):
    return _ordered(spark, sf_dir, "hue")


@register("order_light", _order_sql("val DESC"))
def order_light(spark, sf_dir):
    return _ordered(spark, sf_dir, "light")


@register("order_number", _order_sql("p_size, p_brand"))
def order_number(spark, sf_dir):
    return _ordered(spark, sf_dir, "number")


@register("hue_bands", f"""WITH {METRICS_SQL}
SELECT band, p_partkey FROM (SELECT *, (hue * 12 // 360)::INT AS band, row_number() OVER (PARTITION BY hue * 12 // 360 ORDER BY CASE WHEN p_size >= 10 THEN 0 ELSE 1 END, sat DESC, p_partkey) AS k FROM metrics WHERE hue * 12 // 360 < 12) WHERE k = 1""")
def hue_bands(spark, sf_dir):
    return search.hue_bands(part_colors(spark, sf_dir), 12, F.col("p_size") >= 10, "p_partkey").select("band", "p_partkey")


@register("contrast_ink", f"WITH {RGB_SQL} SELECT p_partkey, CASE WHEN (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255 > 0.62 THEN '#1b1a19' ELSE '#ffffff' END AS ink FROM rgb")
def contrast_ink(spark, sf_dir):
    return part_rgb(spark, sf_dir).select("p_partkey", color.contrast_ink(F.col("r"), F.col("g"), F.col("b")).alias("ink"))


# -- search ------------------------------------------------------------------------------------

KEYS_SQL = "keys AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 5 = 0 THEN 'PF' ELSE '' END || (p_partkey % 97)::VARCHAR || CASE p_partkey % 4 WHEN 1 THEN 'F' WHEN 2 THEN 'L' WHEN 3 THEN 'LF' ELSE '' END AS k FROM part)"


def part_keys(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    tail = F.when(p % 4 == 1, "F").when(p % 4 == 2, "L").when(p % 4 == 3, "LF").otherwise("")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return part.withColumn("k", F.concat(F.when(p % 5 == 0, "PF").otherwise(""), (p % 97).cast("string"), tail))


@register("key_search", f"WITH {KEYS_SQL} SELECT p_partkey, k FROM keys WHERE regexp_extract(k, '([0-9]+)', 1) = '46' AND starts_with(regexp_extract(k, '[0-9]([A-Z]*)$', 1), 'L')")
def key_search(spark, sf_dir):
    return part_keys(spark, sf_dir).where(search.matches_key(F.col("k"), search.normalised(" 46-l"))).select("p_partkey", "k")


@register("contains_search", f"WITH {KEYS_SQL} SELECT p_partkey, k FROM keys WHERE contains(k, 'PF')")
def contains_search(spark, sf_dir):
    return part_keys(spark, sf_dir).where(search.matches_key(F.col("k"), search.normalised("pf"))).select("p_partkey", "k")


@register("tone_siblings", f"WITH {KEYS_SQL} SELECT a.p_partkey AS k, b.p_partkey AS sibling FROM keys a JOIN keys b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey")
def tone_siblings(spark, sf_dir):
    """Every key with each of its siblings; tone_classes has the classes."""
    p = part_keys(spark, sf_dir).select(F.col("p_partkey").alias("k"), "p_size", "p_brand")
    return search.sibling_pairs(p, "k", ("p_size", "p_brand"))


@register("tone_classes", f"WITH {KEYS_SQL} SELECT p_size AS n, array_to_string(list_sort(list(p_partkey))[:1000], ',') AS keys, count(*) AS size FROM keys GROUP BY p_size")
def tone_classes(spark, sf_dir):
    p = part_keys(spark, sf_dir).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))
    return search.tone_classes(p.withColumnRenamed("n", "number"), "k", "number").select(F.col("number").alias("n"), F.array_join("keys", ",").alias("keys"), F.col("n").alias("size"))


@register("text_search", f"WITH {KEYS_SQL} SELECT k.p_partkey, k.k FROM keys k JOIN part p USING (p_partkey) WHERE contains(k.k, 'RING') OR len(list_filter(string_split(upper(p.p_name), ' '), lambda w: contains(w, 'RING'))) > 0 OR contains(upper(p.p_type), 'RING')")
def text_search(spark, sf_dir):
    """Keys, words and types that hold a text, through an index of grams in the shared folder."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.col("p_type").alias("f"))
    rows = part_keys(spark, sf_dir).select("p_partkey", "k").join(words, "p_partkey")
    folder = shared_folder(spark)
    search.gram_index(rows, "p_partkey", ["k", "w", "f"]).write.parquet(folder)
    return search.text_search(rows, spark.read.parquet(folder), "p_partkey", ["k", "w", "f"], "ring").select("p_partkey", "k")


@register("facet_search", f"""WITH {METRICS_SQL}, f AS (SELECT l_partkey, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, family FROM metrics JOIN f ON p_partkey = l_partkey WHERE family IN ('ブルー', 'グリーン') AND p_size % 2 = 0 AND list_has_any(f, ['N', 'R']) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')""")
def facet_search(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    c = part_colors(spark, sf_dir).join(flags, F.col("p_partkey") == F.col("l_partkey"))
    index = c.select("p_partkey", "family", F.col("family").alias("fam"), "f", F.array("p_brand").alias("b"), (F.col("p_size") % 2 == 0).alias("matte"))
    spec = search.SearchSpec(facets={"fam": frozenset({"ブルー", "グリーン"}), "f": frozenset("NR"), "b": frozenset({"Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"})}, matte_only=True)
    return materialised(index).where(search.predicate(spec)).select("p_partkey", "family")  # the index is made once; a filter folded into its making would make the colours many times


@register("code_search", "SELECT o_custkey, list_sort(list(printf('%06d', o_orderkey))) AS codes FROM orders GROUP BY o_custkey HAVING list_contains(list(printf('%06d', o_orderkey)), '000042') OR o_custkey = 42".replace("list_sort(list(printf('%06d', o_orderkey))) AS codes", "array_to_string(list_sort(list(printf('%06d', o_orderkey))), ' ') AS codes"))
def code_search(spark, sf_dir):
    codes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(merge.sorted_set(labels.printed_number(F.col("o_orderkey"), 6)).alias("codes"))
    none = F.array().cast("array<string>")
    index = codes.select("o_custkey", F.col("o_custkey").cast("string").alias("k"), none.alias("f"), none.alias("w"), "codes")
    return index.where(search.predicate(search.SearchSpec(query="000042"), "codes")).select("o_custkey", F.array_join("codes", " ").alias("codes"))


# -- consensus ---------------------------------------------------------------------------------


@register("upper_median_by_group", "SELECT l_partkey, quantile_disc(l_quantity, 0.5 ORDER BY l_quantity DESC) AS m FROM lineitem GROUP BY l_partkey")
def upper_median_by_group(spark, sf_dir):
    return consensus.medians(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_quantity"]).select("l_partkey", F.col("l_quantity_median").alias("m"))


MEDIAN3 = "med AS (SELECT l_partkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS q, list_sort(list(l_discount))[count(*) // 2 + 1] AS d, list_sort(list(l_tax))[count(*) // 2 + 1] AS t FROM lineitem GROUP BY l_partkey), far AS (SELECT l.*, round(abs(l_quantity - q) + abs(l_discount - d) + abs(l_tax - t), 9) AS distance FROM lineitem l JOIN med USING (l_partkey))"
TRIPLE = ["l_quantity", "l_discount", "l_tax"]


@register("spread", f"WITH {MEDIAN3} SELECT l_partkey, round(CASE WHEN count(*) = 1 THEN 0 ELSE max(distance) END, 6) AS spread FROM far GROUP BY l_partkey")
def spread(spark, sf_dir):
    return consensus.spread(table(spark, sf_dir, "lineitem"), ["l_partkey"], TRIPLE).select("l_partkey", F.round("spread", 6).alias("spread"))


@register("representative", f"WITH {MEDIAN3} SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM far QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY distance, l_orderkey, l_linenumber, l_suppkey) = 1")
def representative(spark, sf_dir):
    out = consensus.representative(table(spark, sf_dir, "lineitem"), ["l_partkey"], TRIPLE, ["l_orderkey", "l_linenumber", "l_suppkey"])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@register("vector_consensus", """WITH long AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(generate_series(1, len(embedding))) AS place FROM embeddings),
med AS (SELECT label, place, list_sort(list(v))[count(*) // 2 + 1] AS m FROM long GROUP BY label, place HAVING count(*) >= 3),
far AS (SELECT label, vec_id, round(sum(abs(v - m)), 6) AS distance FROM long JOIN med USING (label, place) GROUP BY label, vec_id)
SELECT label, vec_id FROM far QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) = 1""")
def vector_consensus(spark, sf_dir):
    return consensus.vector_consensus(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id").select("label", "vec_id")


@register("aspect_outliers", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS ratio FROM lineitem), m AS (SELECT l_suppkey, list_sort(list(ratio))[count(*) // 2 + 1] AS m FROM x GROUP BY l_suppkey)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (ratio / m < 0.8 OR ratio / m > 1.35) AS outliers FROM x JOIN m USING (l_suppkey) GROUP BY l_suppkey""")
def aspect_outliers(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"))
    return consensus.aspect_outliers(x, ["l_suppkey"], "ratio").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if("outlier").alias("outliers"))


@register("oversize_flag", """WITH m AS (SELECT p_brand, list_sort(list(p_size))[count(*) // 2 + 1] AS w, list_sort(list(p_retailprice))[count(*) // 2 + 1] AS h FROM part GROUP BY p_brand)
SELECT p_partkey, p_size / w > 2.2 OR p_retailprice / h > 2.2 OR p_retailprice / h < 0.45 OR p_size / w < 0.25 AS oversized FROM part JOIN m USING (p_brand)""")
def oversize_flag(spark, sf_dir):
    return consensus.oversized(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_partkey", "oversized")


@register("quality_fallback", """WITH x AS (SELECT *, l_discount <= 0.01 AND l_returnflag = 'N' AS good FROM lineitem), g AS (SELECT l_partkey, bool_or(good) AS has_good FROM x GROUP BY l_partkey)
SELECT l_partkey, count(*) AS n, bool_and(NOT has_good) AS unverified FROM x JOIN g USING (l_partkey) WHERE good OR NOT has_good GROUP BY l_partkey""")
def quality_fallback(spark, sf_dir):
    good = (F.col("l_discount") <= 0.01) & (F.col("l_returnflag") == "N")
    kept = consensus.quality_fallback(table(spark, sf_dir, "lineitem"), ["l_partkey"], good)
    return kept.groupBy("l_partkey").agg(F.count("*").alias("n"), F.bool_and("unverified").alias("unverified"))


@register("trimmed_mean", """WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, floor(round(sum(l_extendedprice), 4) / count(*))::BIGINT AS price FROM r WHERE k >= n // 10 AND k < greatest(n * 9 // 10, n // 10 + 1) GROUP BY l_suppkey""")
def trimmed_mean(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,4)"))
    return consensus.trimmed_mean(x, ["l_suppkey"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], ["price"]).select("l_suppkey", F.col("price").cast("long").alias("price"))


@register("percentile_core", """WITH c AS (SELECT event_type, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.85) AS hi FROM events GROUP BY event_type)
SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events JOIN c USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY event_type""")
def percentile_core(spark, sf_dir):
    core = consensus.percentile_core(table(spark, sf_dir, "events"), ["event_type"], "value")
    return core.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@register("quantised_mode", f"""WITH {RGB_SQL}, bins AS (SELECT p_brand, (r // 16) * 1024 + (g // 16) * 32 + b // 16 AS bin, count(*) AS n FROM rgb GROUP BY ALL),
best AS (SELECT p_brand, bin FROM bins QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, bin) = 1)
SELECT p_brand, (bin // 1024 % 32 * 16 + 8)::INT AS r, (bin // 32 % 32 * 16 + 8)::INT AS g, (bin % 32 * 16 + 8)::INT AS b FROM best""")
def quantised_mode(spark, sf_dir):
    return raster.background(part_rgb(spark, sf_dir), "p_brand")


@register("representative_color", f"""WITH {RGB_SQL}, x AS (SELECT *, round(0.299 * r + 0.587 * g + 0.114 * b, 9) AS lum FROM rgb), m AS (SELECT * FROM x WHERE r + g > 200),
u AS (SELECT p_brand, count(*) FILTER (r + g > 200) >= 0.15 * count(*) AS masked FROM x GROUP BY p_brand),
c AS (SELECT x.* FROM x JOIN u USING (p_brand) WHERE NOT masked OR r + g > 200),
q AS (SELECT p_brand, quantile_cont(lum, 0.1) AS lo, quantile_cont(lum, 0.85) AS hi FROM c GROUP BY p_brand)
SELECT p_brand, floor(quantile_cont(r::DOUBLE, 0.5))::INT AS r, floor(quantile_cont(g::DOUBLE, 0.5))::INT AS g, floor(quantile_cont(b::DOUBLE, 0.5))::INT AS b FROM c JOIN q USING (p_brand) WHERE lum BETWEEN lo AND hi GROUP BY p_brand""".replace("round(0.299 * r + 0.587 * g + 0.114 * b, 9)", "round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 9)"))
def representative_color(spark, sf_dir):
    pixels = part_rgb(spark, sf_dir)
    return raster.representative_color(pixels, pixels.where(F.col("r") + F.col("g") > 200), "p_brand")


@register("blob_bbox", """WITH RECURSIVE m AS (SELECT vec_id, (k - 1) // 8 AS y, (k - 1) % 8 AS x, embedding[k] > 0 AS lit FROM embeddings, unnest(generate_series(1, 64)) AS g(k)),
c AS (SELECT DISTINCT vec_id, y // 2 AS r, x // 2 AS q, (y // 2) * 4 + x // 2 + 1 AS label FROM m WHERE lit),
reach AS (SELECT vec_id, r, q, label AS top FROM c UNION SELECT a.vec_id, b.r, b.q, a.top FROM reach a JOIN c b ON a.vec_id = b.vec_id AND abs(a.r - b.r) + abs(a.q - b.q) = 1),
lab AS (SELECT vec_id, r, q, max(top) AS top FROM reach GROUP BY ALL),
best AS (SELECT vec_id, min(r) * 2 AS r0, max(r) * 2 + 1 AS r1, min(q) * 2 AS c0, max(q) * 2 + 1 AS c1 FROM lab GROUP BY vec_id, top QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, top) = 1)
SELECT vec_id, min(x)::INT AS x0, min(y)::INT AS y0, (max(x) + 1)::INT AS x1, (max(y) + 1)::INT AS y1 FROM m JOIN best USING (vec_id) WHERE lit AND y BETWEEN r0 AND r1 AND x BETWEEN c0 AND c1 GROUP BY vec_id""")
def blob_bbox(spark, sf_dir):
    masks = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda x: x > 0).alias("mask"))
    return raster.blob_bounds(masks, "vec_id", pool=2)


# -- labels, codes, tokens ---------------------------------------------------------------------

LABEL_SQL = """tok AS (SELECT p_partkey, ['M', '', 'PF', 'CR-', '0-', ' ', 'TB '][p_partkey % 7 + 1] || CASE WHEN p_partkey % 7 = 4 THEN printf('%04d', p_partkey % 10000) ELSE (p_partkey % 3000)::VARCHAR END || ['', 'F', 'L', 'mm', '・12', 'X'][p_partkey % 6 + 1] AS token FROM part),
cut AS (SELECT p_partkey, token, regexp_replace(split_part(upper(trim(token)), '・', 1), '^[0O]-([0-9]{4})$', 'α-\\1') AS t FROM tok),
read AS (SELECT p_partkey, t, regexp_extract(t, '^(WCR|CRLL|CRS|CHS|CRD|CR|CH|TB|BM|PF|DEMI|M|A|α|Q)?[-\\s]?(PF)?[-\\s]?([0-9]{1,4})([ABCDFHLMSU]{0,3})$', ['prefix', 'pf', 'num', 'suffix']) AS g FROM cut)"""


@register("label_parse", f"""WITH {LABEL_SQL}
SELECT p_partkey, nullif(CASE WHEN g.num <> '' THEN g.prefix END, '') AS prefix, try_cast(g.num AS INT) AS number, CASE WHEN g.num <> '' THEN g.suffix END AS suffix
FROM (SELECT p_partkey, CASE WHEN t IN ('2021', '1M', '0', '') OR regexp_matches(t, '[0-9] *(MM|CM|M|G|KG)$') OR try_cast(g.num AS INT) = 0 THEN NULL ELSE g END AS g FROM read)""")
def label_parse(spark, sf_dir):
    p = F.col("p_partkey")
    pick = lambda items, n: F.get(F.array(*map(F.lit, items)), (p % n).cast("int"))
    number = F.when(p % 7 == 4, F.lpad((p % 10000).cast("string"), 4, "0")).otherwise((p % 3000).cast("string"))
    token = F.concat(pick(["M", "", "PF", "CR-", "0-", " ", "TB "], 7), number, pick(["", "F", "L", "mm", "・12", "X"], 6))
    parsed = table(spark, sf_dir, "part").select("p_partkey", labels.parse_label(token).alias("x"))
    return parsed.select("p_partkey", "x.prefix", "x.number", "x.suffix")


@register("reconcile_cascade", """WITH known AS (SELECT DISTINCT (p_partkey % 400)::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN 'L' ELSE '' END AS key FROM part WHERE p_partkey % 400 > 0),
lab AS (SELECT DISTINCT l_partkey % 60 + 1 AS number, ['', 'F', 'FM', 'L', 'LF', 'S', 'B', 'LS'][l_suppkey % 8 + 1] AS suffix FROM lineitem),
tries AS (SELECT number, suffix, 0 AS rank, number::VARCHAR || suffix AS key FROM lab UNION ALL SELECT number, suffix, 1, number::VARCHAR || suffix[:-3] FROM lab WHERE suffix LIKE '%FM'
UNION ALL SELECT number, suffix, 2, number::VARCHAR || suffix[:-2] FROM lab WHERE suffix LIKE '%F' UNION ALL SELECT number, suffix, 3, number::VARCHAR || translate(suffix, 'LSBD', '1580') FROM lab WHERE regexp_matches(suffix, '^[LSBD]+$')),
hit AS (SELECT number, suffix, rank, key FROM tries JOIN known USING (key) QUALIFY row_number() OVER (PARTITION BY number, suffix ORDER BY rank) = 1)
SELECT number, suffix, CASE WHEN rank = 3 THEN key ELSE number::VARCHAR || suffix END AS fixed_key, coalesce(key, number::VARCHAR || suffix) AS base_key FROM lab LEFT JOIN hit USING (number, suffix)""")
def reconcile_cascade(spark, sf_dir):
    p = F.col("p_partkey")
    known = table(spark, sf_dir, "part").where(p % 400 > 0).select(F.concat((p % 400).cast("string"), F.when(p % 3 == 0, "L").otherwise("")).alias("key"))
    tails = F.array(*map(F.lit, ["", "F", "FM", "L", "LF", "S", "B", "LS"]))
    found = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60 + 1).alias("number"), F.get(tails, (F.col("l_suppkey") % 8).cast("int")).alias("suffix")).distinct()
    return merge.reconcile(found, known).select("number", "suffix", "fixed_key", "base_key")


@register("token_classify", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice::BIGINT::VARCHAR || '円' WHEN 1 THEN printf('%06d', o_orderkey) WHEN 2 THEN '4964291-' || printf('%06d', o_orderkey) WHEN 3 THEN '約' || (o_orderkey % 90)::VARCHAR || 'g入' ELSE o_orderstatus END AS token FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'price' WHEN 1 THEN CASE WHEN length(token) = 6 THEN 'productCode' END WHEN 2 THEN CASE WHEN length(token) = 14 THEN 'jan' END WHEN 3 THEN 'quantity' WHEN 4 THEN CASE WHEN token = 'F' THEN 'style' END END AS kind, CASE o_orderkey % 5 WHEN 0 THEN replace(token, '円', '') WHEN 1 THEN CASE WHEN length(token) = 6 THEN token END WHEN 2 THEN CASE WHEN length(token) = 14 THEN replace(token, '-', '') END WHEN 4 THEN CASE WHEN token = 'F' THEN token END ELSE token END AS value FROM t""")
def token_classify(spark, sf_dir):
    k = F.col("o_orderkey")
    code = labels.printed_number(k, 6)
    token = F.when(k % 5 == 0, F.concat(F.rint("o_totalprice").cast("long").cast("string"), F.lit("円"))).when(k % 5 == 1, code).when(k % 5 == 2, F.concat(F.lit("4964291-"), code)).when(k % 5 == 3, F.concat(F.lit("約"), k % 90, F.lit("g入"))).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.classify_token(token, ("F",)).alias("c")).select("o_orderkey", "c.kind", "c.value")


@register("json_multivalue", "SELECT event_type, json_extract_string(props, '$.k')::INT AS k, count(*) AS n, sum(len(regexp_extract_all('「' || event_type || '」「' || user_id::VARCHAR || '」', '「([^」]*)」', 1)))::BIGINT AS parts FROM events GROUP BY ALL")
def json_multivalue(spark, sf_dir):
    both = labels.bracketed(F.concat(F.lit("「"), F.col("event_type"), F.lit("」「"), F.col("user_id").cast("string"), F.lit("」")))
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"), F.size(both).alias("parts"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.sum("parts").alias("parts"))


@register("code_split_unglue", """WITH x AS (SELECT p_partkey, (p_partkey % 9000 + 1000)::VARCHAR AS a, ((p_partkey * 7) % 9000 + 1000)::VARCHAR AS b FROM part) SELECT p_partkey, a || ',' || a || ',' || b || CASE WHEN p_partkey % 2 = 0 THEN ',' || b || 'F' ELSE '' END AS codes, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + 1 AS rejected FROM x""")
def code_split_unglue(spark, sf_dir):
    p = F.col("p_partkey")
    a, b = (p % 9000 + 1000).cast("string"), ((p * 7) % 9000 + 1000).cast("string")
    run = F.concat(a, F.lit("，"), a, b, F.when(p % 2 == 0, F.concat(F.lit("、"), b, F.lit("f"))).otherwise(""), F.when(p % 3 == 0, ",?x").otherwise(""), F.lit("※note 12"))
    out = table(spark, sf_dir, "part").select("p_partkey", labels.split_codes(run).alias("s"))
    return out.select("p_partkey", F.array_join("s.codes", ",").alias("codes"), F.size("s.rejected").alias("rejected"))


@register("size_mm", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 THEN p_size ELSE (p_size + p_size + 2) / 2.0 END::DOUBLE AS mm FROM part")
def size_mm(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size")
    label = F.when(p % 4 == 0, F.concat(s, F.lit("〜x"))).when(p % 4 == 1, s.cast("string")).when(p % 4 == 2, F.concat(s, F.lit("〜"), s + 2)).otherwise(F.concat(s, F.lit(".0～"), s + 2))
    return table(spark, sf_dir, "part").select("p_partkey", labels.size_mm(label).alias("mm"))


@register("suffix_notes", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '色調: 最も淡い|F: つや消し（frosted）加工' WHEN 2 THEN 'FM: 着色またはパールのつや消し加工（つや消しが強い）' ELSE 'S: 銀メッキ系の同色番|U: ダブルスリーカット系の同色番' END AS notes FROM part")
def suffix_notes(spark, sf_dir):
    s = F.get(F.array(F.lit(""), F.lit("LF"), F.lit("FM"), F.lit("SU")), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(labels.suffix_notes(s), "|").alias("notes"))


# -- layout ------------------------------------------------------------------------------------


def event_seconds(spark, sf_dir) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_seconds(ts).alias("sec"), ts.cast("date").alias("day"))


@register("gap_clusters", """WITH e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS sec FROM (SELECT *, date_trunc('second', ts) AS t FROM events)), g AS (SELECT user_id, CASE WHEN sec - lag(sec) OVER w > 3600 OR lag(sec) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)) SELECT user_id, sum(new)::BIGINT AS clusters FROM g GROUP BY user_id""".replace("epoch(ts)::BIGINT", "epoch(t)::BIGINT"))
def gap_clusters(spark, sf_dir):
    e = spatial.gap_clusters(event_seconds(spark, sf_dir), ["user_id"], ["sec", "event_id"], "sec", F.lit(3600))
    return e.groupBy("user_id").agg(F.max("cluster").alias("clusters"))


@register("islands_same_key", """WITH g AS (SELECT user_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, sum(new)::BIGINT AS islands FROM g GROUP BY user_id""")
def islands_same_key(spark, sf_dir):
    e = spatial.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return e.groupBy("user_id").agg(F.max("island").alias("islands"))


@register("line_fold", """WITH v AS (SELECT user_id, list_sort(list(value)) AS vs FROM events GROUP BY user_id)
SELECT user_id, len(list_reduce(list_prepend([vs[1]], list_transform(vs, lambda x: [x])), lambda a, x: CASE WHEN abs(x[1] - a[len(a)]) <= 4.5 THEN a ELSE list_append(a, x[1]) END))::INT AS lines FROM v""")
def line_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("vs"))
    return e.select("user_id", F.size(spatial.line_fold(F.col("vs"), 4.5)).alias("lines"))


@register("event_lines", """WITH v AS (SELECT user_id, list_sort(list(value)) AS vs FROM events GROUP BY user_id),
a AS (SELECT user_id, list_reduce(list_prepend([vs[1]], list_transform(vs, lambda x: [x])), lambda a, x: CASE WHEN abs(x[1] - a[len(a)]) <= 4.5 THEN a ELSE list_append(a, x[1]) END) AS anchors FROM v)
SELECT event_id, list_max(list_filter(anchors, lambda x: x <= value)) AS line FROM events JOIN a USING (user_id)""")
def event_lines(spark, sf_dir):
    """The line of each event, by pointers."""
    return spatial.lines_of(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", "line")


@register("shared_price_fold", """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 OR l_linenumber = 4 THEN l_extendedprice END AS price, CASE WHEN l_linenumber <> 1 THEN l_partkey END AS code FROM lineitem),
f AS (SELECT l_orderkey, count(*) FILTER (price IS NOT NULL AND code IS NULL) AS p, count(*) FILTER (code IS NOT NULL AND price IS NULL) AS c, max(price) FILTER (code IS NULL) AS shared FROM v GROUP BY l_orderkey)
SELECT l_orderkey, count(*) AS n, count(CASE WHEN p = 1 AND c > 0 AND price IS NULL AND code IS NOT NULL THEN shared ELSE price END) AS priced FROM v JOIN f USING (l_orderkey) WHERE NOT (p = 1 AND c > 0 AND price IS NOT NULL AND code IS NULL) GROUP BY l_orderkey""")
def shared_price_fold(spark, sf_dir):
    n = F.col("l_linenumber")
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(n.isin(1, 4), F.col("l_extendedprice")).alias("price"), F.when(n != 1, F.col("l_partkey")).alias("code"))
    return spatial.shared_price(v, ["l_orderkey"], "price", "code").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count("price").alias("priced"))


@register("ordinal_names", "WITH x AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || '_' || n::VARCHAR END AS name FROM x")
def ordinal_names(spark, sf_dir):
    return spatial.ordinal_names(table(spark, sf_dir, "part"), ["p_brand"], "p_type", ["p_partkey"]).select("p_partkey", "name")


@register("nearest_cell", """WITH d AS (SELECT a.p_brand, a.p_partkey AS token_id, b.p_partkey AS cell_id, round(abs(a.p_retailprice - b.p_retailprice) * 1.8 + abs(a.p_size - b.p_size), 6) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND a.p_size BETWEEN b.p_size - 2 AND b.p_size + 34)
SELECT token_id, cell_id, distance FROM d WHERE distance < 40 QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY distance, cell_id) = 1""")
def nearest_cell(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select("p_brand", F.col("p_partkey").alias("token_id"), F.col("p_retailprice").alias("x"), F.col("p_size").alias("y"))
    b = p.select("p_brand", F.col("p_partkey").alias("cell_id"), F.col("p_retailprice").alias("bx"), F.col("p_size").alias("by"))
    d = F.round(spatial.box_distance(*map(F.col, ("x", "x", "y", "y", "bx", "bx", "by", "by")), 1.8), 6)
    band = F.col("y").between(F.col("by") - 2, F.col("by") + 34)
    axes = [((F.col(c), F.col(c)), (F.col(f"b{c}"), F.col(f"b{c}")), reach) for c, reach in (("x", 40 / 1.8), ("y", 40.0))]
    return spatial.nearest(a, b, ["p_brand"], "token_id", "cell_id", band, d, 40, axes, (["x", "y"], ["bx", "by"]), apart=True).select("token_id", "cell_id", "distance")


@register("overlap_fraction", """WITH x AS (SELECT p_brand, p_partkey, p_retailprice - p_size AS lo, p_retailprice + p_size AS hi FROM part)
SELECT a.p_partkey, round(least(1, coalesce(sum(CASE WHEN a.p_partkey <> b.p_partkey THEN greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (a.hi - a.lo) END), 0)), 6) AS overlap FROM x a JOIN x b USING (p_brand) GROUP BY a.p_partkey""")
def overlap_fraction(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), "p_partkey", (F.col("p_retailprice") - F.col("p_size")).alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    one = [F.lit(0.0), F.lit(1.0)]
    rects = p.select("page", F.col("p_partkey").alias("rect_id"), F.col("p_partkey").alias("label_id"), F.col("lo").alias("x0"), F.col("hi").alias("x1"), one[0].alias("y0"), one[1].alias("y1"))
    blocks = p.select("page", F.col("p_partkey").alias("block_id"), F.col("lo").alias("bx0"), F.col("hi").alias("bx1"), one[0].alias("by0"), one[1].alias("by1"))
    return spatial.overlap_fraction(rects, blocks).select(F.col("rect_id").alias("p_partkey"), F.round("overlap", 6).alias("overlap"))


@register("next_column", """WITH e AS (SELECT DISTINCT n_regionkey, n_nationkey * 5 AS edge FROM nation), s AS (SELECT s_suppkey, n_regionkey, (s_suppkey % 130)::INT AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, min(edge) FILTER (edge > x + 8) AS next, max(edge) FILTER (edge <= x + 6) AS back FROM s LEFT JOIN e USING (n_regionkey) GROUP BY s_suppkey""")
def next_column(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    edges = nation.select("n_regionkey", (F.col("n_nationkey") * 5).alias("edge")).distinct()
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey", (F.col("s_suppkey") % 130).cast("int").alias("x"))
    ahead = spatial.asof(s, edges, ["n_regionkey"], "x", "edge", forward=True, gap=8).withColumnRenamed("edge", "next")
    return spatial.asof(ahead, edges, ["n_regionkey"], "x", "edge", gap=6).select("s_suppkey", "next", F.col("edge").alias("back"))


@register("grid_intervals", "SELECT p_brand, low, high FROM (SELECT p_brand, p_size AS low, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS high FROM (SELECT DISTINCT p_brand, p_size FROM part)) WHERE high IS NOT NULL")
def grid_intervals(spark, sf_dir):
    return spatial.grid_intervals(table(spark, sf_dir, "part").select("p_brand", "p_size").distinct(), ["p_brand"], "p_size")


# -- merging -----------------------------------------------------------------------------------


@register("merge_precedence", """SELECT doc_id AS key, coalesce(label, quality) AS value, vec_id IS NOT NULL AS better FROM labels LEFT JOIN embeddings ON vec_id = doc_id UNION ALL SELECT vec_id, label, true FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def merge_precedence(spark, sf_dir):
    """The label of a vector goes before the quality of the document of its number; vectors without one are appended."""
    base = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("value"))
    better = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("value"))
    return merge.append_missing(merge.override(base, better, "key", ["value"], "better"), better.withColumn("better", F.lit(True)), "key")


@register("last_wins", "SELECT l_partkey, l_extendedprice, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1")
def last_wins(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return merge.last_writer(x, "l_partkey", ["l_extendedprice", "l_quantity"], ["o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey"])


@register("price_override", """WITH live AS (SELECT p_partkey, p_retailprice FROM part WHERE p_size > 25) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_retailprice, CASE WHEN l_linenumber < 4 THEN l_extendedprice END) AS price FROM lineitem LEFT JOIN live ON l_partkey = p_partkey WHERE coalesce(p_retailprice, CASE WHEN l_linenumber < 4 THEN l_extendedprice END) IS NOT NULL""")
def price_override(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("code"), F.when(F.col("l_linenumber") < 4, F.col("l_extendedprice")).alias("price"))
    live = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("price"))
    return merge.priced(v, live).select("l_orderkey", "l_linenumber", F.col("code").alias("l_partkey"), "l_suppkey", "price")


@register("codes_by_group", "SELECT p_brand, array_to_string(list_sort(list(printf('%06d', p_partkey))), ' ') AS codes FROM part GROUP BY p_brand")
def codes_by_group(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(merge.sorted_set(labels.printed_number(F.col("p_partkey"), 6)), " ").alias("codes"))


@register("distinct_with_price", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_discount > 0.05")
def distinct_with_price(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_discount > 0.05").agg(F.countDistinct("l_partkey").alias("n"))


@register("official_index", "SELECT p_brand AS key, arg_min(p_name, p_partkey) AS printed, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS words, array_to_string(list(p_size::VARCHAR ORDER BY p_partkey), ',') AS shapes FROM part GROUP BY p_brand")
def official_index(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("key"), F.col("p_name").alias("printed"), F.array("p_type").alias("words"), F.array("p_name").alias("finishes"), F.col("p_size").cast("string").alias("shape"))
    return merge.official_index(rows).select("key", "printed", F.array_join("words", "|").alias("words"), F.array_join("shapes", ",").alias("shapes"))


@register("consecutive_groups", "WITH g AS (SELECT *, CASE WHEN n_regionkey = lag(n_regionkey) OVER (ORDER BY n_nationkey) THEN 0 ELSE 1 END AS new FROM nation), r AS (SELECT *, sum(new) OVER (ORDER BY n_nationkey)::BIGINT AS run FROM g) SELECT run, n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS vals FROM r GROUP BY run, n_regionkey")
def consecutive_groups(spark, sf_dir):
    return merge.consecutive_groups(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name").select("run", "n_regionkey", F.array_join("values", ",").alias("vals"))


# -- audits and publishing ---------------------------------------------------------------------

SYNONYMS = {"src1": ["en", "fr"], "src2": ["de"], "src3": ["es", "fr"]}


@register("agreement_check", """WITH x AS (SELECT d.doc_id, source, lang, l.doc_id IS NOT NULL AS there, CASE WHEN contains(source, 'src1') THEN ['en', 'fr'] ELSE [] END || CASE WHEN contains(source, 'src2') THEN ['de'] ELSE [] END || CASE WHEN contains(source, 'src3') THEN ['es', 'fr'] ELSE [] END AS e FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CASE WHEN NOT there THEN 'only_mine' WHEN len(e) > 0 AND len(list_distinct(e)) = 1 AND e[1] = lang THEN 'agree' ELSE 'disagree' END AS outcome, count(*) AS n FROM x GROUP BY 1""")
def agreement_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mine = docs.select("doc_id", F.array("source").alias("names"))
    theirs = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.array("lang").alias("terms"))
    return audit.agreement(mine, theirs, "doc_id", SYNONYMS).groupBy("outcome").agg(F.count("*").alias("n"))


@register("coverage_audit", "SELECT k AS id, CASE WHEN v IS NULL THEN 'missing' WHEN d IS NULL THEN 'extra' ELSE 'covered' END AS state FROM (SELECT DISTINCT doc_id AS k, 1 AS d FROM labels) FULL JOIN (SELECT DISTINCT vec_id AS k, 1 AS v FROM embeddings) USING (k)")
def coverage_audit(spark, sf_dir):
    """Labelled documents with and without a vector, and vectors of documents without a label."""
    return audit.coverage(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id")


@register("card_check", """WITH card AS (SELECT CASE WHEN p_partkey % 400 = 0 THEN NULL ELSE (p_partkey % 400)::VARCHAR || ['', 'F', 'L'][p_partkey % 3 + 1] END AS key, arg_min((p_partkey % 400)::VARCHAR || ['', 'F', 'L'][p_partkey % 3 + 1], p_partkey) AS printed FROM part GROUP BY key HAVING key IS NOT NULL),
mine AS (SELECT (l_partkey % 500 + 1)::VARCHAR || ['', 'F', 'L'][l_linenumber % 3 + 1] AS key, bool_or(l_returnflag = 'R' OR l_quantity > 45) AS round FROM lineitem GROUP BY 1)
SELECT key, printed, CASE WHEN printed IS NULL THEN 'extra' WHEN round IS NULL THEN 'missing' WHEN round THEN 'covered' ELSE 'wrong_type' END AS state, row_number() OVER (ORDER BY length(key), key) AS place FROM card FULL JOIN mine USING (key) WHERE printed IS NOT NULL OR round
UNION ALL SELECT NULL, '?', 'unparsed', NULL FROM part WHERE p_partkey % 400 = 0""")
def card_check(spark, sf_dir):
    """Codes of all parts as a printed card, against colours of all line items; in order of length and text."""
    p, tail = F.col("p_partkey"), lambda n: F.get(F.array(F.lit(""), F.lit("F"), F.lit("L")), (n % 3).cast("int"))
    card = table(spark, sf_dir, "part").select(p.alias("pos"), F.when(p % 400 == 0, "?").otherwise(F.concat((p % 400).cast("string"), tail(p))).alias("printed"))
    item = table(spark, sf_dir, "lineitem")
    types = F.when(F.col("l_returnflag") == "R", F.array(F.lit("丸小"))).otherwise(F.array(F.lit("x")))
    colors = item.select(F.concat((F.col("l_partkey") % 500 + 1).cast("string"), tail(F.col("l_linenumber"))).alias("key"), types.alias("types"), F.when(F.col("l_quantity") > 45, F.array(F.lit("丸大ビーズ"))).alias("categories"))
    told = audit.card_check(card, colors)
    place = F.row_number().over(Window.orderBy(F.length("key"), "key"))  # over the keys of one card
    keyed = audit.by_length(told.where("key IS NOT NULL"), "key").withColumn("place", place.cast("long"))
    return keyed.unionByName(told.where("key IS NULL").withColumn("place", F.lit(None).cast("long")))


@register("unknown_keys", "SELECT o_custkey, array_to_string(list_sort(list(printf('%08d', o_orderkey))), ',') AS places, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY o_custkey")
def unknown_keys(spark, sf_dir):
    """Customers with orders that no event knows."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", labels.printed_number(F.col("o_orderkey"), 8).alias("place"))
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"))
    return audit.unknown_keys(rows, known, "o_custkey", "place").select("o_custkey", F.array_join("places", ",").alias("places"), "n")


@register("page_report", "SELECT l_suppkey, round(avg(l_discount), 4) AS mean_overlap, count(*) FILTER (l_discount <= 0.02) AS clean, count(*) AS cells FROM lineitem GROUP BY l_suppkey")
def page_report(spark, sf_dir):
    return audit.page_report(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount")


@register("word_frequency", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n\\t]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word")
def word_frequency(spark, sf_dir):
    words = F.array_remove(F.split(F.lower("text"), r"[ \n\t]+"), "")
    return audit.frequencies(table(spark, sf_dir, "benchmark"), words, "word")


@register("fit_sentences", """WITH s AS (SELECT conv_id, list(text ORDER BY turn, role, text) AS ss FROM conversations GROUP BY conv_id)
SELECT conv_id, list_reduce(list_prepend('', ss), lambda o, s: CASE WHEN o <> '' AND len(o) + len(s) > 155 THEN o ELSE o || s END) AS description FROM s""")
def fit_sentences(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", text.fit_sentences(F.transform("t", lambda x: x["text"]), 155).alias("description"))


@register("sitemap_union", "SELECT 0 AS part, '/r/' || r_regionkey AS path, 'https://x.test/r/' || r_regionkey AS url FROM region UNION ALL SELECT 1, '/n/' || n_nationkey, 'https://x.test/n/' || n_nationkey FROM nation UNION ALL SELECT 2, '/p/' || p_partkey, 'https://x.test/p/' || p_partkey FROM part")
def sitemap_union(spark, sf_dir):
    paths = [table(spark, sf_dir, t).select(F.concat(F.lit(f"/{p}/"), F.col(c).cast("string")).alias("path")) for t, p, c in (("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("part", "p", "p_partkey"))]
    return sinks.sitemap("https://x.test/", *paths)


@register("page_neighbours", "SELECT r_regionkey AS page, lag(r_regionkey) OVER (ORDER BY r_regionkey) AS previous, lead(r_regionkey) OVER (ORDER BY r_regionkey) AS next FROM region")
def page_neighbours(spark, sf_dir):
    return search.page_neighbours(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("page")))


@register("printed_codes", "SELECT code, min(pos)::INT AS pos FROM (SELECT unnest(regexp_split_to_array(upper(trim(p_name)), '\\s+')) AS code, unnest(generate_series(0, len(regexp_split_to_array(upper(trim(p_name)), '\\s+')) - 1)) AS pos FROM part) GROUP BY code")
def printed_codes(spark, sf_dir):
    return sources.printed_codes(table(spark, sf_dir, "part"), "p_name")
