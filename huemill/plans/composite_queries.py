"""Operator graphs and the rows of pages over the driver's tables, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huemill.functions import labels
from huemill.operators import audit, consensus, merge, pages, search, spatial
from huemill.plans.catalogue_queries import KEYS_SQL, LAB_SQL, METRICS_SQL, PICKED, RGB_SQL, SYNONYMS, part_colors, part_keys, part_rgb, table
from huemill.plans.registry import register
from huemill.session import materialised


# -- the browser: text, facets, a picked colour and codes in one search ------------------------


@register("browser_results", f"""WITH {LAB_SQL.replace("FROM part)", "FROM part UNION ALL SELECT -1, 0, '', '', 60, 120, 180)")}, {KEYS_SQL}, {METRICS_SQL[METRICS_SQL.index("unit AS") :]},
f AS (SELECT l_partkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY l_partkey)
SELECT lab.p_partkey, keys.k, round(sqrt((lab.L - p.L) ** 2 + (lab.A - p.A) ** 2 + (lab.B - p.B) ** 2), 9) AS distance FROM lab JOIN keys USING (p_partkey) JOIN metrics ON metrics.p_partkey = lab.p_partkey JOIN f ON l_partkey = lab.p_partkey, lab p
WHERE p.p_partkey = -1 AND lab.p_partkey > 0 AND family IN ('ブルー', 'グリーン', 'パープル', 'レッド', 'オレンジ', 'イエロー') AND list_has_any(f, ['N', 'R'])
AND ((regexp_extract(keys.k, '([0-9]+)', 1) = '46' AND starts_with(regexp_extract(keys.k, '^([A-Z]*)', 1), '')) OR lab.p_partkey = 46 OR contains(metrics.p_brand, '46'))
ORDER BY distance, lab.p_partkey LIMIT 120""")
def browser_results(spark, sf_dir):
    """Number, code or word 46 among six families with two finishes, nearest to a picked colour first."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("f"))
    c = part_colors(spark, sf_dir).join(flags, F.col("p_partkey") == F.col("l_partkey")).join(part_keys(spark, sf_dir).select("p_partkey", "k"), "p_partkey")
    named = c.select("p_partkey", F.col("k").alias("key"), "hex", "hue", "sat", "val", "family", F.col("f").alias("finishes"), F.array("p_brand").alias("words"), F.array(F.col("p_partkey").cast("string")).alias("codes"))
    index = materialised(search.color_index(named, ("p_partkey", "codes")))
    families = frozenset({"ブルー", "グリーン", "パープル", "レッド", "オレンジ", "イエロー"})
    spec = search.SearchSpec(query=" 46 ", facets={"fam": families, "f": frozenset("NR")}).picking(PICKED)
    return search.search(index, spec, position="p_partkey", codes="codes").select("p_partkey", "k", "distance")


# -- three sources to nested documents ---------------------------------------------------------

APPEARANCES_SQL = """seen AS (SELECT l_partkey AS key, l_suppkey AS page, l_orderkey * 8 + l_linenumber AS pos, l_extendedprice AS price, l_orderkey AS code, l_returnflag AS style, l_discount <= 0.01 AND l_returnflag = 'N' AS good FROM lineitem),
kept AS (SELECT * FROM seen QUALIFY good OR NOT bool_or(good) OVER (PARTITION BY key))"""


def _appearances(spark, sf_dir) -> DataFrame:
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    good = (F.col("l_discount") <= 0.01) & (F.col("l_returnflag") == "N")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("page"), at.alias("pos"), F.col("l_linenumber").alias("vpos"), F.col("l_returnflag").alias("line"), F.col("l_returnflag").alias("style"),
        F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("code"), F.col("l_quantity").alias("quantity"), good.alias("good"),
    )


def _documents(spark, sf_dir, variants: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of all colours: base names, those of a better source over them, colours that only that source has; and the appearances that quality keeps, and all."""
    seen = _appearances(spark, sf_dir)
    kept = consensus.quality_fallback(seen, ["key"], F.col("good"))
    part = table(spark, sf_dir, "part")
    base = part.where("p_size > 10").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    better = part.where("p_size > 25 or p_size < 5").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("name"))
    colors = merge.append_missing(merge.override(base, better, "key", ["name"], "official"), better.withColumn("official", F.lit(True)), "key")
    appearances = kept.groupBy("key", "page", "pos").agg(F.min("line").alias("line")).withColumn("printed_as", F.col("line"))
    of_each = kept.select("key", "page", "pos", "vpos", "style", "price", "code", "quantity") if variants else None
    return merge.color_documents(colors, appearances, of_each), kept, seen


@register("catalogue_documents", f"""WITH {APPEARANCES_SQL},
colors AS (SELECT p_partkey AS key, CASE WHEN p_size > 25 OR p_size < 5 THEN p_type ELSE p_name END AS name, p_size > 25 OR p_size < 5 AS official FROM part WHERE p_size > 10 OR p_size < 5),
a AS (SELECT key, count(DISTINCT (page, pos)) AS n_appearances, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, round(sum(price), 2) AS total FROM kept GROUP BY key)
SELECT key, name, official, coalesce(n_appearances, 0)::BIGINT AS n_appearances, coalesce(pages, '') AS pages, coalesce(total, 0) AS total FROM colors LEFT JOIN a USING (key)""")
def catalogue_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir)[0]
    prices = F.flatten(F.transform("appearances", lambda a: F.transform(a["variants"], lambda v: v["price"])))
    total = F.round(F.aggregate(prices, F.lit(0.0), lambda a, x: a + x), 2)
    return docs.select("key", "name", "official", F.size("appearances").cast("long").alias("n_appearances"), F.array_join(pages.pages_of(F.col("appearances")), ",").alias("pages"), total.alias("total"))


@register("catalogue_counters", f"""WITH {APPEARANCES_SQL}, colors AS (SELECT p_partkey AS key FROM part WHERE p_size > 10 OR p_size < 5)
SELECT 'colors' AS counter, count(*) AS n FROM colors UNION ALL SELECT 'appearances', count(DISTINCT (key, page, pos)) FROM kept JOIN colors USING (key) UNION ALL SELECT 'dropped', count(*) FILTER (NOT good) FROM seen
UNION ALL SELECT 'pages', count(DISTINCT page) FROM kept UNION ALL SELECT 'codes', count(DISTINCT code) FROM kept""")
def catalogue_counters(spark, sf_dir):
    return pages.counters(*_documents(spark, sf_dir, variants=False))  # which no counter counts


@register("price_seed", """WITH v AS (SELECT printf('%06d', l_partkey) AS code, l_orderkey * 8 + l_linenumber AS pos, l_suppkey AS page, l_extendedprice AS price, CASE WHEN l_linenumber > 3 THEN '' ELSE l_returnflag END AS style, l_linestatus AS sales_style FROM lineitem)
SELECT code, arg_max(page, (pos, page, price)) AS page, arg_max(price, (pos, page, price)) AS price, arg_max(coalesce(nullif(style, ''), sales_style), (pos, page, price)) AS style FROM v GROUP BY code""")
def price_seed(spark, sf_dir):
    at = F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_suppkey").alias("page"), F.col("l_extendedprice").alias("price"))
    v = table(spark, sf_dir, "lineitem").select(
        labels.printed_number(F.col("l_partkey"), 6).alias("code"), at.alias("pos"), F.col("l_suppkey").alias("page"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("color_key"),
        F.col("l_returnflag").alias("line"), F.when(F.col("l_linenumber") > 3, "").otherwise(F.col("l_returnflag")).alias("style"), F.col("l_linestatus").alias("sales_style"), F.col("l_quantity").alias("quantity"),
    )
    return merge.price_seed(v).select("code", "page", "price", "style")


# -- cells of a page ---------------------------------------------------------------------------

CELLS_SQL = """tokens AS (SELECT p_brand AS page, p_partkey AS token_id, p_retailprice AS x0, p_retailprice + 4 AS x1, p_size * 9.0 AS cy, CASE WHEN p_size % 2 = 0 THEN 'price' ELSE 'note' END AS kind FROM part),
cells AS (SELECT p_brand AS page, p_partkey AS cell_id, p_retailprice AS bx0, p_retailprice + 12 AS bx1, p_size * 9.0 AS by0, p_size * 9.0 + 14 AS by1 FROM part WHERE p_type = 'SMALL'),
near AS (SELECT page, token_id, cell_id, greatest(bx0 - x1, x0 - bx1, 0) * 1.8 + greatest(by0 - cy, cy - by1, 0) AS d FROM tokens JOIN cells USING (page) WHERE cy BETWEEN by0 - 2 AND by1 + 34),
met AS (SELECT * FROM near WHERE d < 40 QUALIFY row_number() OVER (PARTITION BY page, token_id ORDER BY d, cell_id) = 1),
orphans AS (SELECT * FROM tokens WHERE kind = 'price' AND token_id NOT IN (SELECT token_id FROM met)),
steps AS (SELECT page, token_id, coalesce(abs(x0 - lag(x0) OVER w) < 34 AND cy - lag(cy) OVER w >= 0 AND cy - lag(cy) OVER w < 22, false) AS joins FROM orphans WINDOW w AS (PARTITION BY page ORDER BY round_even(x0 / 30, 0), cy, token_id))"""


def _cells(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), "p_partkey", F.col("p_retailprice").alias("x0"), (F.col("p_size") * 9.0).alias("cy"), "p_size", "p_type")
    kind = F.when(F.col("p_size") % 2 == 0, "price").otherwise("note")
    tokens = p.select("page", F.col("p_partkey").alias("token_id"), "x0", (F.col("x0") + 4).alias("x1"), "cy", kind.alias("kind"))
    cells = p.where(F.col("p_type") == "SMALL").select("page", F.col("p_partkey").alias("cell_id"), F.col("x0").alias("bx0"), (F.col("x0") + 12).alias("bx1"), F.col("cy").alias("by0"), (F.col("cy") + 14).alias("by1"))
    return spatial.tokens_to_cells(tokens, cells)


@register("cell_tokens", f"WITH {CELLS_SQL} SELECT token_id, cell_id FROM met")
def cell_tokens(spark, sf_dir):
    return _cells(spark, sf_dir)[0].select("token_id", "cell_id")


@register("orphan_groups", f"WITH {CELLS_SQL} SELECT page, count(*) AS orphans, count(*) FILTER (NOT joins) AS groups FROM steps GROUP BY page")
def orphan_groups(spark, sf_dir):
    grouped = pages.orphan_groups(_cells(spark, sf_dir)[1], x="x0")
    return grouped.groupBy("page").agg(F.count("*").alias("orphans"), F.max("group").alias("groups"))


@register("photo_captions", """WITH r AS (SELECT p_brand AS page, p_partkey AS rect_id, p_retailprice AS x0, p_retailprice + p_size AS x1, p_size * 11.0 AS y0, p_size * 12.0 AS y1 FROM part WHERE p_size >= 12),
c AS (SELECT p_brand AS page, p_partkey AS caption_id, p_retailprice + 9 AS x0, p_retailprice + 30 AS x1, p_size * 12.0 + 3 AS y0, p_size * 12.0 + 12 AS y1 FROM part WHERE p_type = 'ECONOMY'),
ok AS (SELECT page FROM (SELECT page, count(*) AS n FROM r GROUP BY page) JOIN (SELECT page, count(*) AS m FROM c GROUP BY page) USING (page) WHERE n >= greatest(4, m / 2)),
d AS (SELECT rect_id, caption_id, 2.2 * greatest(c.x0 - r.x1, r.x0 - c.x1, 0) + greatest(c.y0 - r.y1, r.y0 - c.y1, 0) + CASE WHEN (c.y0 + c.y1) / 2 > r.y1 THEN 0 ELSE 14 END AS d FROM r JOIN c USING (page) WHERE page IN (SELECT page FROM ok))
SELECT rect_id, caption_id FROM d WHERE d < 60 QUALIFY row_number() OVER (PARTITION BY rect_id ORDER BY d, caption_id) = 1""")
def photo_captions(spark, sf_dir):
    p, x, s = table(spark, sf_dir, "part"), F.col("p_retailprice"), F.col("p_size")
    rects = p.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("rect_id"), x.alias("rx0"), (x + s).alias("rx1"), (s * 11.0).alias("ry0"), (s * 12.0).alias("ry1"))
    captions = p.where(F.col("p_type") == "ECONOMY").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("caption_id"), (x + 9).alias("cx0"), (x + 30).alias("cx1"), (s * 12.0 + 3).alias("cy0"), (s * 12.0 + 12).alias("cy1"))
    return spatial.photos_to_captions(rects, captions).select("rect_id", "caption_id")


@register("column_edges", """WITH e AS (SELECT user_id, value, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 2, true) AS new FROM events),
g AS (SELECT user_id, value, sum(new::INT) OVER (PARTITION BY user_id ORDER BY value) AS cluster FROM e), c AS (SELECT user_id, min(value) AS edge, count(*) AS n FROM g GROUP BY user_id, cluster)
SELECT user_id, edge FROM c QUALIFY n >= 2 OR (max(n) OVER (PARTITION BY user_id) < 2 AND edge = min(edge) OVER (PARTITION BY user_id))""")
def column_edges(spark, sf_dir):
    return spatial.column_edges(table(spark, sf_dir, "events"), "user_id", "value", F.lit(2.0))


@register("regions_of_labels", """WITH l AS (SELECT p_partkey, p_retailprice AS x0, p_retailprice + p_size AS x1, p_size * 9.0 AS y0, p_size * 9.0 + 8 AS y1, p_retailprice - 1 AS col, CASE WHEN p_size < 40 THEN p_retailprice + 40 END AS next_col, p_size * 2.0 AS pitch, p_size * 8.0 AS ceiling FROM part),
c AS (SELECT p_partkey, 0 AS ord, x1 + 1.5 AS x0, y0 - 3.5 AS y0, coalesce(next_col - 3, 2100) AS x1, y1 + 3.5 AS y1, 8 AS w, 0 AS h FROM l UNION ALL SELECT p_partkey, 1, col - 2, greatest(ceiling, y0 - 1.05 * pitch), col + pitch - 6, y0 - 1.5, 4, 10 FROM l)
SELECT p_partkey, ord, round((x1 - x0)::DOUBLE, 6) AS width, round((y1 - y0)::DOUBLE, 6) AS height FROM c WHERE x1 - x0 >= w AND y1 - y0 >= h AND x1 - x0 >= 4 AND y1 - y0 >= 3""")
def regions_of_labels(spark, sf_dir):
    p, s, x = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_retailprice")
    placed = p.select(
        F.col("p_brand").alias("page"), F.col("p_partkey").alias("cell_id"), x.alias("x0"), (x + s).alias("x1"), (s * 9.0).alias("y0"), (s * 9.0 + 8).alias("y1"), (x - 1).alias("col"), F.when(s < 40, x + 40).alias("next_col"), (s * 2.0).alias("pitch"), (s * 8.0).alias("ceiling"),
    )
    out = pages.regions(placed, F.lit(2100.0))
    return out.select(F.col("cell_id").alias("p_partkey"), "ord", F.round(F.col("x1") - F.col("x0"), 6).alias("width"), F.round(F.col("y1") - F.col("y0"), 6).alias("height"))


@register("chosen_layout", """WITH e AS (SELECT l_suppkey AS page, l_orderkey * 8 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'N'), d AS (SELECT l_suppkey AS page, l_orderkey * 8 + l_linenumber AS id FROM lineitem WHERE l_returnflag <> 'N'),
n AS (SELECT page, coalesce(e, 0) >= coalesce(d, 0) AS first FROM (SELECT page, count(*) AS e FROM e GROUP BY page) FULL JOIN (SELECT page, count(*) AS d FROM d GROUP BY page) USING (page))
SELECT page, id FROM e WHERE page IN (SELECT page FROM n WHERE first) UNION ALL SELECT page, id FROM d WHERE page IN (SELECT page FROM n WHERE NOT first)""")
def chosen_layout(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_returnflag")  # noqa: E741
    return pages.chosen_layout(l.where("l_returnflag = 'N'").select("page", "id"), l.where("l_returnflag <> 'N'").select("page", "id"))


@register("recovered_labels", "SELECT l_partkey, arg_max(l_returnflag, (l_discount, -(l_orderkey * 8 + l_linenumber), l_returnflag)) AS label, max(l_discount) AS conf FROM lineitem WHERE l_discount >= 0.03 GROUP BY l_partkey")
def recovered_labels(spark, sf_dir):
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    readings = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("label"), F.col("l_discount").alias("conf"), at.alias("pos"))
    return pages.recovered_labels(readings, ["l_partkey"], 0.03)


@register("without_ground", f"WITH {RGB_SQL}, m AS (SELECT *, r > 232 AND g > 232 AND b > 232 AS white FROM rgb) SELECT p_brand, p_partkey FROM m QUALIFY NOT white OR count(*) FILTER (NOT white) OVER (PARTITION BY p_brand) < 12")
def without_ground(spark, sf_dir):
    return consensus.without_ground(part_rgb(spark, sf_dir), ["p_brand"], ["r", "g", "b"]).select("p_brand", "p_partkey")


# -- pages of the site -------------------------------------------------------------------------


@register("agreement_rate", """WITH x AS (SELECT lang, l.doc_id IS NOT NULL AS there, CASE WHEN contains(source, 'src1') THEN ['en', 'fr'] ELSE [] END || CASE WHEN contains(source, 'src2') THEN ['de'] ELSE [] END || CASE WHEN contains(source, 'src3') THEN ['es', 'fr'] ELSE [] END AS e FROM documents d LEFT JOIN labels l USING (doc_id)),
o AS (SELECT CASE WHEN NOT there THEN 'only_mine' WHEN len(e) > 0 AND len(list_distinct(e)) = 1 AND e[1] = lang THEN 'agree' ELSE 'disagree' END AS outcome FROM x),
n AS (SELECT count(*) FILTER (outcome = 'agree') AS agree, count(*) FILTER (outcome = 'disagree') AS disagree, count(*) FILTER (outcome = 'only_mine') AS only_mine, 0::BIGINT AS only_theirs FROM o)
SELECT *, round(coalesce(100.0::DOUBLE * agree / nullif(agree + disagree, 0), 0), 6) AS percent FROM n""")
def agreement_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    theirs = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.array("lang").alias("terms"))
    rate = audit.agreement_rate(audit.agreement(docs.select("doc_id", F.array("source").alias("names")), theirs, "doc_id", SYNONYMS))
    return rate.withColumn("percent", F.round("percent", 6))


@register("lines_on_pages", "SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY first, line) AS place FROM (SELECT l_suppkey AS page, l_returnflag || l_linestatus AS line, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY ALL)")
def lines_on_pages(spark, sf_dir):
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return pages.lines_on(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.concat("l_returnflag", "l_linestatus").alias("line"), at.alias("pos")))


@register("colors_on_page", "SELECT p_partkey AS key, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)")
def colors_on_page(spark, sf_dir):
    colors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return pages.colors_on(colors, _appearances(spark, sf_dir), F.lit(1))


@register("point_lookup", "SELECT p_partkey, p_name FROM part WHERE p_name = (SELECT min(p_name) FROM part WHERE p_partkey = 7) ORDER BY p_partkey LIMIT 1")
def point_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name = part.where("p_partkey = 7").agg(F.min("p_name")).first()[0]
    return pages.lookup(part, name or "", "p_name", "p_partkey")


@register("types_of_lines", "SELECT p_brand AS line, array_to_string(list_sort(list(DISTINCT t)), '|') AS types FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS t FROM part) GROUP BY p_brand")
def types_of_lines(spark, sf_dir):
    lines = pages.types_of_lines(table(spark, sf_dir, "part").select(F.col("p_brand").alias("line"), F.split("p_name", " ").alias("types")))
    return lines.select("line", F.array_join("types", "|").alias("types"))


@register("shapes_by_size", "SELECT p_brand, array_to_string(list(p_type || ' ' || p_size::VARCHAR ORDER BY p_size, p_type, p_partkey), '|') AS shapes FROM part GROUP BY p_brand")
def shapes_by_size(spark, sf_dir):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type", "p_size"))), lambda s: F.struct(s["p_type"].alias("category"), s["p_size"].cast("string").alias("size"), s["p_size"].alias("mm")))
    by_brand = table(spark, sf_dir, "part").groupBy("p_brand").agg(listed.alias("shapes"))
    return by_brand.select("p_brand", F.array_join(F.transform(pages.shapes_by_size(F.col("shapes")), lambda s: F.concat_ws(" ", s["category"], s["size"])), "|").alias("shapes"))


@register("distinct_styles", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS style FROM part")
def distinct_styles(spark, sf_dir):
    return pages.distinct_styles(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("styles")))


@register("usable_photos", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 3.5 * l_linenumber AND l_tax * 3000 >= 215")
def usable_photos(spark, sf_dir):
    photos = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("width"), F.col("l_linenumber").alias("height"), (F.col("l_tax") * 3000).alias("corner"))
    return pages.usable_photos(photos).select("l_orderkey", "l_linenumber", "l_partkey")


@register("photo_sizes", "SELECT c_custkey, coalesce(w, 0) AS width, coalesce(h, 0) AS height FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS w, count(DISTINCT o_orderstatus) AS h FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def photo_sizes(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("width"), F.countDistinct("o_orderstatus").alias("height"))
    return pages.with_photo_sizes(table(spark, sf_dir, "customer").select("c_custkey"), sizes, "c_custkey")


@register("noted_variations", "SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS n_colors FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def noted_variations(spark, sf_dir):
    """Customers in credit stand for variations with a note."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, "credit").otherwise("").alias("note"))
    by = pages.noted(rows).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.collect_set("c_mktsegment").alias("numbers"))
    return pages.colors_per_variation(by).select("c_nationkey", "n", "n_colors")
