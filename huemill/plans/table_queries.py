"""Finish tables from blocks and rules: suppliers are pages, line items their text blocks, line numbers the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huemill.functions import labels
from huemill.operators import finishes
from huemill.plans.catalogue_queries import table
from huemill.plans.registry import register

METHODS_SQL = "[" + ", ".join(f"'{m}'" for m in labels.METHODS) + "]"

TABLE_SQL = f"""blocks AS (SELECT l_suppkey AS page, l_orderkey * 8 + l_linenumber AS block_id, l_orderkey % 4 AS side, [30, 110, 230, 400][l_orderkey % 4 + 1] AS cx, l_linenumber * 100 + (l_quantity - 1) * 2 AS cy,
  CASE l_orderkey % 4 WHEN 0 THEN l_returnflag || l_linenumber WHEN 1 THEN l_quantity::INT::VARCHAR WHEN 2 THEN CASE WHEN l_discount = 0.05 THEN 'ラスター' ELSE l_returnflag END
  ELSE (l_partkey % 9000 + 1000)::VARCHAR || CASE WHEN l_discount = 0.01 THEN 'f' ELSE '' END || CASE WHEN l_tax = 0.02 THEN ',?x' ELSE '' END || CASE WHEN l_quantity = 50 THEN '※a ' || l_partkey ELSE '' END END AS text FROM lineitem),
marks AS (SELECT DISTINCT l_suppkey AS page, l_linenumber * 100 AS at_y, l_linenumber % 3 = 1 AS opens FROM lineitem UNION ALL SELECT DISTINCT l_suppkey, 900, true FROM lineitem),
kept AS (SELECT page, at_y, bool_or(opens) AS opens FROM marks GROUP BY ALL),
rows_of AS (SELECT page, at_y AS y0, lead(at_y) OVER (PARTITION BY page ORDER BY at_y) AS y1, sum(opens::INT) OVER (PARTITION BY page ORDER BY at_y) - 1 AS grp FROM kept),
lines AS (SELECT * FROM rows_of WHERE y1 IS NOT NULL AND grp >= 0),
groups AS (SELECT page, grp, min(y0) AS y0, max(y1) AS y1 FROM lines GROUP BY page, grp),
kinds AS (SELECT g.page, g.grp, string_agg(text, '' ORDER BY cy, cx, block_id, text) AS kind FROM groups g JOIN blocks b ON b.page = g.page AND cy BETWEEN y0 AND y1 AND side = 0 GROUP BY ALL),
prose AS (SELECT g.page, g.grp, list_reduce(list_prepend('', list(text ORDER BY cy, cx, block_id, text)), lambda o, p: o || CASE WHEN o <> '' AND regexp_matches(o, '[0-9A-Za-z]$') AND regexp_matches(p, '^[0-9]') THEN '・' ELSE '' END || p) AS description
  FROM groups g JOIN blocks b ON b.page = g.page AND cy BETWEEN y0 AND y1 AND side = 1 GROUP BY ALL),
names AS (SELECT l.page, grp, y0, string_agg(text, '' ORDER BY cy, cx, block_id, text) AS label FROM lines l JOIN blocks b ON b.page = l.page AND cy BETWEEN y0 AND y1 AND side = 2 GROUP BY ALL),
runs AS (SELECT l.page, grp, y0, string_agg(text, ',' ORDER BY cy, cx, block_id, text) AS raw FROM lines l JOIN blocks b ON b.page = l.page AND cy BETWEEN y0 AND y1 AND side = 3 GROUP BY ALL),
tokens AS (SELECT *, list_filter(string_split(upper(split_part(raw, '※', 1)), ','), lambda t: t <> '') AS ts FROM runs),
coded AS (SELECT page, grp, y0, raw, list_filter(ts, lambda t: regexp_full_match(t, '(PF)?[0-9]{{1,4}}[A-Z]{{0,3}}')) AS codes, list_filter(ts, lambda t: NOT regexp_full_match(t, '(PF)?[0-9]{{1,4}}[A-Z]{{0,3}}')) AS bad FROM tokens),
found AS (SELECT c.page, c.grp AS "group", c.y0, kind, coalesce(description, '') AS description, row_number() OVER (PARTITION BY c.page, c.grp ORDER BY c.y0) - 1 AS place, coalesce(label, kind) AS name, codes, bad, raw,
  CASE WHEN contains(raw, '※') THEN array_to_string(list_transform(string_split(raw, '※')[2:], lambda p: trim(p)), '；') END AS note
  FROM coded c JOIN kinds k USING (page, grp) LEFT JOIN prose p USING (page, grp) LEFT JOIN names n ON n.page = c.page AND n.grp = c.grp AND n.y0 = c.y0 WHERE len(codes) > 0)"""


def blocks_and_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of four columns; the first line of three opens a group; rules that end early or are short mean nothing."""
    x = table(spark, sf_dir, "lineitem")
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    side = (F.col("l_orderkey") % 4).cast("int")
    codes = F.concat((part % 9000 + 1000).cast("string"), F.when(F.col("l_discount") == 0.01, "f").otherwise(""), F.when(F.col("l_tax") == 0.02, ",?x").otherwise(""), F.when(F.col("l_quantity") == 50, F.concat(F.lit("※a "), part)).otherwise(""))
    text = F.when(side == 0, F.concat("l_returnflag", line)).when(side == 1, F.col("l_quantity").cast("int").cast("string")).when(side == 2, F.when(F.col("l_discount") == 0.05, "ラスター").otherwise(F.col("l_returnflag"))).otherwise(codes)
    cx = F.get(F.array(F.lit(30.0), F.lit(110.0), F.lit(230.0), F.lit(400.0)), side)
    blocks = x.select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 8 + line).alias("block_id"), text.alias("text"), cx.alias("cx"), (line * 100 + (F.col("l_quantity") - 1) * 2).alias("cy"))
    rule = lambda orient, pos, a, b: F.struct(F.lit(orient).alias("orient"), pos.cast("double").alias("pos"), F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b"))
    flat = rule("h", line * 100, 0, 500).withField("a", F.when(line % 3 == 1, 0.0).otherwise(165.0))
    per_line = x.select("l_suppkey", "l_linenumber").distinct().select(F.col("l_suppkey").alias("page"), F.inline(F.array(flat, rule("h", line * 100 + 50, 0, 420), rule("h", line * 100 + 60, 250, 500))))
    tall = F.array(*(rule("v", F.lit(p), 0, b) for p, b in ((60.2, 900), (159.8, 900), (300, 890), (200, 150))))
    per_page = x.select("l_suppkey").distinct().select(F.col("l_suppkey").alias("page"), F.inline(tall))
    return blocks, per_line.unionByName(per_page)


@register("extract_finishes", f"""WITH {TABLE_SQL}
SELECT page, "group"::BIGINT AS "group", kind AS name, description, count(*) AS n, string_agg(concat_ws('|', name, array_to_string(list_filter({METHODS_SQL}, lambda m: contains(name, m)), '+'), array_to_string(codes, ' '), coalesce(note, '-')), chr(10) ORDER BY place) AS variations
FROM found GROUP BY ALL""")
def extract_finishes(spark, sf_dir):
    """Nested finishes of every page, variations as lines of text."""
    out = finishes.nested(finishes.variations(*blocks_and_rules(spark, sf_dir)))
    line = lambda v: F.concat_ws("|", v["name"], F.array_join(v["methods"], "+"), F.array_join(v["colorNumbers"], " "), F.coalesce(v["note"], F.lit("-")))
    return out.select("page", F.col("group").cast("long").alias("group"), "name", "description", F.size("variations").cast("long").alias("n"), F.array_join(F.transform("variations", line), "\n").alias("variations"))


@register("finish_rejects", f"""WITH {TABLE_SQL} SELECT page, kind AS finish, array_to_string(bad, ' ') AS tokens, raw FROM found WHERE len(bad) > 0""")
def finish_rejects(spark, sf_dir):
    """Tokens of code cells that are no codes."""
    out = finishes.rejected(finishes.variations(*blocks_and_rules(spark, sf_dir)))
    return out.select("page", "finish", F.array_join("tokens", " ").alias("tokens"), "raw")
