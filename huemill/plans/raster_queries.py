"""Rasters of the driver's tables: each document's bytes are an image of 48 pixels across, three bytes a pixel, whole rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huemill.operators import consensus, pages, raster
from huemill.plans.catalogue_queries import table
from huemill.plans.registry import register
from huemill.session import materialised, shared_folder
from huemill.sources import rasters

ACROSS = 48

PIXELS_SQL = f"""bytes AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '.{{6}}') AS ps FROM documents),
placed AS (SELECT doc_id::VARCHAR AS img, unnest(ps[:len(ps) // {ACROSS} * {ACROSS}]) AS v, unnest(range(len(ps) // {ACROSS} * {ACROSS})) AS p FROM bytes),
px AS MATERIALIZED (SELECT img, (p // {ACROSS})::INT AS y, (p % {ACROSS})::INT AS x, ('0x' || v[1:2])::INT AS r, ('0x' || v[3:4])::INT AS g, ('0x' || v[5:6])::INT AS b FROM placed)"""


def document_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, y, x, r, g, b of every document of a row of pixels or more."""
    parts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("img"), F.regexp_extract_all(F.hex("text"), F.lit("(.{6})"), F.lit(1)).alias("ps"))
    whole = parts.select("img", F.posexplode(F.slice("ps", F.lit(1), F.floor(F.size("ps") / ACROSS).cast("int") * ACROSS)).alias("p", "v"))
    level = whole.select("img", "p", F.conv("v", 16, 10).cast("int").alias("v"))
    return level.select("img", F.floor(F.col("p") / ACROSS).cast("int").alias("y"), (F.col("p") % ACROSS).alias("x"), F.shiftright("v", 16).alias("r"), (F.shiftright("v", 8) % 256).alias("g"), (F.col("v") % 256).alias("b"))


#: Lines of a strip.
LINES = 2048


def document_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images as strips of whole lines: img, top, lines, width, height, data, three bytes a pixel."""
    whole = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("img"), F.col("text").cast("binary").alias("bytes"), F.floor(F.octet_length("text") / (3 * ACROSS)).cast("int").alias("height")).where("height > 0")
    cut = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(LINES))).alias("top")).withColumn("lines", F.least(F.lit(LINES), F.col("height") - F.col("top")))
    return cut.select("img", "top", "lines", F.lit(ACROSS).alias("width"), "height", F.substring("bytes", F.col("top") * 3 * ACROSS + 1, F.col("lines") * 3 * ACROSS).alias("data"))


def resized_sql(source: str, name: str, width: int, height: int) -> str:
    """Tables `name` (img, y, x, r, g, b): source resampled by the triangle filter, in plain joins and sums."""

    def weights(axis: str, out: int) -> str:
        scale = f"(len / {out}::DOUBLE)"
        centre, reach = f"((o + 0.5::DOUBLE) * {scale})", f"greatest({scale}, 1::DOUBLE)"
        low, high = f"greatest(0, floor({centre} - {reach} + 0.5::DOUBLE))::BIGINT", f"least(len, floor({centre} + {reach} + 0.5::DOUBLE))::BIGINT"
        raw = f"SELECT len, o, pos, greatest(0::DOUBLE, 1 - abs((pos - {centre} + 0.5::DOUBLE) / {reach})) AS raw FROM (SELECT DISTINCT {axis} AS len FROM {name}_size), range({out}) AS a(o), unnest(generate_series({low}, {high} - 1)) AS s(pos)"
        return f"{name}_{axis} AS MATERIALIZED (SELECT len, o, pos, floor(0.5::DOUBLE + raw / sum(raw) OVER (PARTITION BY len, o) * {1 << raster.BITS})::BIGINT AS k FROM ({raw}))"

    level = ", ".join(f"least(255, (sum({c} * k)::BIGINT + {1 << raster.BITS - 1}) >> {raster.BITS})::INT AS {c}" for c in "rgb")
    return f"""{name}_size AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM {source} GROUP BY img), {weights("w", width)}, {weights("h", height)},
{name}_flat AS MATERIALIZED (SELECT img, h, y, o AS x, {level} FROM {source} JOIN {name}_size USING (img) JOIN {name}_w k ON len = w AND pos = x GROUP BY img, h, y, o),
{name} AS MATERIALIZED (SELECT img, o AS y, x, {level} FROM {name}_flat JOIN {name}_h k ON len = h AND pos = y GROUP BY img, x, o)"""


def core_color_sql(small: str, above: int, fewest: int) -> str:
    return f"""beads AS (SELECT *, r > {above} AND g > {above} AND b > {above} AS white, count(*) FILTER (NOT (r > {above} AND g > {above} AND b > {above})) OVER (PARTITION BY img) AS n_beads FROM {small}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY r + g + b, y, x) - 1 AS k, count(*) OVER (PARTITION BY img) AS n FROM beads WHERE NOT white OR n_beads < {fewest})
SELECT img, (sum(r) // count(*))::INT AS r, (sum(g) // count(*))::INT AS g, (sum(b) // count(*))::INT AS b FROM ranked WHERE k >= n // 10 AND k < greatest(n * 9 // 10, n // 10 + 1) GROUP BY img"""


@register("page_slices", f"""WITH {PIXELS_SQL}
SELECT img, count(*) AS n, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM px WHERE x BETWEEN 8 AND 39 AND y BETWEEN 4 AND 19 GROUP BY img""")
def page_slices(spark, sf_dir):
    """A rectangle of every image: the rasters are written as packs of image files and read back as a slice."""
    folder = shared_folder(spark)
    rasters.write_packs(document_strips(spark, sf_dir), folder)
    cut = rasters.pages(spark, folder).where("x >= 8 AND x < 40 AND y >= 4 AND y < 20")
    return cut.groupBy("img").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "rgb"))


@register("page_crops", f"""WITH {PIXELS_SQL}, rects AS (SELECT l_orderkey * 8 + l_linenumber AS rect_id, l_partkey, l_suppkey, l_partkey::VARCHAR AS img, l_suppkey % 40 AS x0, l_linenumber * 2 AS y0, l_suppkey % 40 + l_quantity::INT AS x1, l_linenumber * 3 + 2 AS y1 FROM lineitem)
SELECT rect_id, l_partkey, l_suppkey, count(*) AS n, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM rects JOIN px USING (img) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL""")
def page_crops(spark, sf_dir):
    """Sums over a rectangle of a page for each line item."""
    line = F.col("l_linenumber")
    rects = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + line).alias("rect_id"), "l_partkey", "l_suppkey", F.col("l_partkey").cast("string").alias("img"),
        (F.col("l_suppkey") % 40).alias("x0"), (line * 2).alias("y0"), (F.col("l_suppkey") % 40 + F.col("l_quantity").cast("int")).alias("x1"), (line * 3 + 2).alias("y1"),
    )
    return raster.crop_sums(document_strips(spark, sf_dir), rects, LINES).groupBy("rect_id", "l_partkey", "l_suppkey").agg(*(F.sum(c).alias(c) for c in ("n", "r", "g", "b")))


@register("fingerprint_consensus", f"""WITH {PIXELS_SQL}, {resized_sql("px", "thumb", 12, 4)},
long AS (SELECT lang, doc_id, 3 * (12 * y + x) + c AS place, v FROM (SELECT *, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM thumb) JOIN documents ON doc_id::VARCHAR = img),
med AS (SELECT lang, place, list_sort(list(v))[count(*) // 2 + 1] AS m FROM long GROUP BY lang, place HAVING count(*) >= 3),
far AS (SELECT lang, doc_id, sum(abs(v - m))::DOUBLE AS distance FROM long JOIN med USING (lang, place) GROUP BY lang, doc_id)
SELECT lang, doc_id, distance FROM far QUALIFY row_number() OVER (PARTITION BY lang ORDER BY distance, doc_id) = 1""")
def fingerprint_consensus(spark, sf_dir):
    """Of each language the document whose thumbnail is nearest to the language's median thumbnail."""
    prints = materialised(raster.strip_fingerprints(document_strips(spark, sf_dir)))
    of = table(spark, sf_dir, "documents").select("doc_id", "lang")
    both = prints.join(of, F.col("img") == F.col("doc_id").cast("string"))
    return consensus.vector_consensus(both, "lang", "fingerprint", "doc_id").select("lang", "doc_id", "distance")


@register("photo_colors", f"WITH {PIXELS_SQL}, {resized_sql('px', 'thumb', 48, 16)}, {core_color_sql('thumb', 232, 12)}")
def photo_colors(spark, sf_dir):
    return raster.strip_photo_colors(document_strips(spark, sf_dir))


@register("swatch_colors", f"""WITH {PIXELS_SQL}, margins AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h, round_even(least(max(x) + 1, max(y) + 1) * 0.2::DOUBLE, 0)::INT AS m FROM px GROUP BY img),
centre AS MATERIALIZED (SELECT img, y - m AS y, x - m AS x, r, g, b FROM px JOIN margins USING (img) WHERE x >= m AND x < w - m AND y >= m AND y < h - m), {resized_sql("centre", "thumb", 32, 32)}, {core_color_sql("thumb", 236, 32)}""")
def swatch_colors(spark, sf_dir):
    return raster.strip_swatch_colors(document_strips(spark, sf_dir))


@register("trimmed_artwork", """WITH RECURSIVE m AS (SELECT vec_id, (k - 1) // 8 AS y, (k - 1) % 8 AS x, embedding[k] > 0 AS up FROM embeddings, unnest(generate_series(1, 64)) AS g(k)),
n AS (SELECT vec_id, count(*) FILTER (up) AS ups FROM m GROUP BY vec_id),
art AS (SELECT vec_id, y, x FROM m JOIN n USING (vec_id) WHERE up = (ups <= 32) AND CASE WHEN ups <= 32 THEN ups ELSE 64 - ups END >= 12),
c AS (SELECT DISTINCT vec_id, y // 2 AS r, x // 2 AS q, (y // 2) * 4 + x // 2 AS label FROM art),
reach AS (SELECT vec_id, r, q, label AS top FROM c UNION SELECT a.vec_id, b.r, b.q, a.top FROM reach a JOIN c b ON a.vec_id = b.vec_id AND abs(a.r - b.r) + abs(a.q - b.q) = 1),
lab AS (SELECT vec_id, r, q, max(top) AS top FROM reach GROUP BY ALL),
best AS (SELECT vec_id, min(r) * 2 AS r0, max(r) * 2 + 1 AS r1, min(q) * 2 AS c0, max(q) * 2 + 1 AS c1 FROM lab GROUP BY vec_id, top QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, top) = 1),
box AS (SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM art JOIN best USING (vec_id) WHERE y BETWEEN r0 AND r1 AND x BETWEEN c0 AND c1 GROUP BY vec_id),
fill AS (SELECT b.vec_id, g.x, (SELECT count(*) FROM art a WHERE a.vec_id = b.vec_id AND a.x = g.x AND a.y BETWEEN b.y0 AND b.y1) / (b.y1 - b.y0 + 1)::DOUBLE AS share FROM box b, unnest(generate_series(b.x0, b.x1)) AS g(x)),
peeled AS (SELECT vec_id, CASE WHEN count(*) < 5 OR median(share) >= 0.85::DOUBLE OR min(x) FILTER (share < 0.92::DOUBLE) IS NULL THEN min(x) ELSE min(x) FILTER (share < 0.92::DOUBLE) END AS a,
  CASE WHEN count(*) < 5 OR median(share) >= 0.85::DOUBLE OR min(x) FILTER (share < 0.92::DOUBLE) IS NULL THEN max(x) ELSE max(x) FILTER (share < 0.92::DOUBLE) END AS z FROM fill GROUP BY vec_id)
SELECT vec_id, greatest(10 + a * 2 - 0.6::DOUBLE, 10) AS x0, greatest(20 + y0 * 3 - 0.6::DOUBLE, 20) AS y0, least(10 + (z + 1) * 2 + 0.6::DOUBLE, 26) AS x1, least(20 + (y1 + 1) * 3 + 0.6::DOUBLE, 44) AS y1 FROM box JOIN peeled USING (vec_id)""")
def trimmed_artwork(spark, sf_dir):
    """Embeddings as 8 x 8 pictures in two colours, each in a rectangle of 16 x 24 points that is tightened to its artwork."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    level = F.when(F.col("v") > 0, 200).otherwise(10)
    pixels = vectors.select(F.col("vec_id").alias("img"), F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), *(level.alias(c) for c in "rgb"))
    rects = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), *(F.lit(x).alias(n) for n, x in {"x0": 10.0, "y0": 20.0, "x1": 26.0, "y1": 44.0}.items()))
    return pages.trim(pixels, rects, pool=2).withColumnRenamed("img", "vec_id")
