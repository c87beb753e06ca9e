"""Printed finish tables: from text blocks and table rules to nested finishes and rejected tokens.

A table has columns (kind, description, variation, codes) and rows; runs of rows form a group, one finish each.
Blocks come to their cells by one sorted sweep down the page: its distinct bounds cut the height into
elementary elementary intervals, numbered 2k + 1 between bounds k and k + 1 and 2k on bound k itself, and a block takes
the number of the last bound before it. Rows and groups are runs of such numbers, ends included, so that a block on an edge
lies in both neighbours. They meet blocks by equality of page and number; no block is held against cells that it isn't in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huemill.functions import labels
from huemill.names import fresh
from huemill.session import materialised

#: Columns of a finish table, and between which of its vertical bounds each lies.
COLUMNS = {"kind": 0, "description": 1, "variation": 2, "codes": 3}
#: How far a rule may be from the table's edge, points; how long its verticals are; how far a row's bound may be from its group's.
EDGE, TALL, NEAR = 20, 200, 0.5


def table_frame(rules: DataFrame) -> DataFrame:
    """(page, left, right, bottom, columns, var): extent of each page's table; columns are all vertical bounds, var the x where the variations begin.

    rules: page, orient, pos, a, b. Pages without a tall vertical rule or without a horizontal one have no table.
    """
    tall = rules.where((F.col("orient") == "v") & (F.col("b") - F.col("a") > TALL)).groupBy("page").agg(F.array_sort(F.collect_set(F.bround("pos", 0))).alias("xs"), F.max("b").alias("bottom"))
    flat = rules.where("orient = 'h'").groupBy("page").agg(F.min("a").alias("left"), F.max("b").alias("right"))
    var = F.when(F.size("xs") >= 2, F.get("xs", F.size("xs") - 2)).otherwise(F.get("xs", 0))
    return tall.join(flat, "page").select("page", "left", "right", "bottom", F.concat(F.array("left"), "xs", F.array("right")).alias("columns"), var.alias("var"))


def table_rows(rules: DataFrame, frame: DataFrame) -> DataFrame:
    """(page, at, opens): bounds of rows from the top; opens: the bound is one of groups too. The bottom closes both."""
    flat = rules.where("orient = 'h'").join(frame, "page").where((F.col("b") >= F.col("right") - EDGE))
    whole, part = F.col("a") <= F.col("left") + EDGE, F.col("a") <= F.col("var") + EDGE
    marks = flat.where(whole | part).select("page", F.col("pos").alias("at"), whole.alias("opens"))
    return marks.unionByName(frame.select("page", F.col("bottom").alias("at"), F.lit(True).alias("opens"))).groupBy("page", "at").agg(F.max("opens").alias("opens"))


def elementary(points: DataFrame, bounds: DataFrame, on: list[str], value: str, at: str, name: str) -> DataFrame:
    """points with `name`: 2k + 1 between bounds k and k + 1 (from 0), 2k on bound k, -1 before all and where value is null. bounds: on, at, distinct.

    Both are one sorted run per group; a point takes the number and the place of the last bound that isn't after it.
    """
    v, point, k, last = (fresh(c, points, bounds) for c in ("v", "point", "k", "last"))
    rows = points.select("*", F.col(value).alias(v), F.lit(True).alias(point))
    marks = bounds.select(*on, F.col(at).cast(points.schema[value].dataType).alias(v), F.lit(False).alias(point))
    run = Window.partitionBy(*on).orderBy(v, point).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True)
    both = both.withColumns({k: F.count_if(~F.col(point)).over(run), last: F.last(F.when(~F.col(point), F.col(v)), ignorenulls=True).over(run)})
    number = F.when(F.col(k) == 0, -1).when(F.col(last) == F.col(v), 2 * F.col(k) - 2).otherwise(2 * F.col(k) - 1).cast("int")
    return both.where(F.col(point)).select(*points.columns, number.alias(name))


def nested_rows(bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (page, group, lo, hi) and their rows (page, group, row, lo, hi) as runs of elementary numbers; bounds: table_rows().

    A bound belongs to the groups that it is in, or nearer to than NEAR; consecutive ones of a group bound a row.
    """
    w = Window.partitionBy("page").orderBy("at")
    placed = bounds.select("page", "at", "opens", (F.row_number().over(w) - 1).alias("k"), F.count_if("opens").over(w).alias("opened"))
    heads = placed.where("opens").select("page", (F.col("opened") - 1).alias("group"), F.col("at").alias("g0"), F.lead("at").over(w).alias("g1"), F.col("k").alias("k0"), F.lead("k").over(w).alias("k1")).where("g1 IS NOT NULL")
    # from the group that ends no more than about NEAR before a bound to the one that starts no more than that after it
    reach = lambda end: F.expr(f"count_if(opens) OVER (PARTITION BY page ORDER BY at RANGE BETWEEN UNBOUNDED PRECEDING AND {1.1 * NEAR}D {end})")
    spanned = placed.select("page", "at", "k", reach("PRECEDING").alias("ended"), reach("FOLLOWING").alias("begun"))
    candidates = spanned.select("page", "at", "k", F.explode(F.sequence(F.col("ended") - 1, F.col("begun") - 1)).alias("group"))
    mine = candidates.join(heads, ["page", "group"]).where((F.col("at") >= F.col("g0") - NEAR) & (F.col("at") <= F.col("g1") + NEAR))
    own = Window.partitionBy("page", "group").orderBy("k")
    rows = mine.select("page", "group", (F.row_number().over(own) - 1).alias("row"), F.col("k").alias("a"), F.lead("k").over(own).alias("z")).where("z IS NOT NULL")
    run = lambda a, z: ((2 * F.col(a)).alias("lo"), (2 * F.col(z)).alias("hi"))
    return heads.select("page", "group", *run("k0", "k1")), rows.select("page", "group", "row", *run("a", "z"))


def _in_reading_order() -> Column:
    """Texts of a cell's blocks, from the top, then from the left."""
    order = F.sort_array(F.collect_list(F.struct(F.bround("cy", 1).alias("y"), "cx", "block_id", "text")))  # compiled, which array_sort's comparison isn't
    return order.getField("text")


def cells(blocks: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts of the cells of groups (page, group, kind, description) and of rows (page, group, row, variation, codes): arrays in reading order, null where a cell is empty.

    blocks: page, block_id, text, cx, cy. Rules, bounds and the placed blocks are stored, as several branches read each.
    """
    rules = materialised(rules)
    frame = materialised(table_frame(rules))
    bounds = materialised(table_rows(rules, frame))
    placed = elementary(blocks.select("page", "block_id", "text", "cx", "cy"), bounds, ["page"], "cy", "at", "y").where("y >= 0")
    inside = lambda k: (F.col("cx") >= F.get("columns", k)) & (F.col("cx") <= F.get("columns", k + 1))
    sides = F.array_compact(F.array(*(F.when(inside(k), F.lit(c)) for c, k in COLUMNS.items())))
    told = placed.join(frame.select("page", "columns"), "page").select("page", "block_id", "text", "cx", "cy", "y", F.explode(sides).alias("column"))
    told = materialised(told)
    groups, rows = nested_rows(bounds)

    def read(runs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        numbers = runs.select("page", *keys, F.explode(F.sequence("lo", "hi")).alias("y"))
        met = told.where(F.col("column").isin(columns)).join(numbers, ["page", "y"])
        return met.groupBy("page", *keys).pivot("column", columns).agg(_in_reading_order())

    return read(groups, ["group"], ["kind", "description"]), read(rows, ["group", "row"], ["variation", "codes"])


def variations(blocks: DataFrame, rules: DataFrame, kind_fixes: dict[str, str] | None = None, name_fallbacks: dict[tuple[str, int], str] | None = None) -> DataFrame:
    """(page, group, row, kind, description, place, name, methods, numbers, note, rejected, raw): one row per table row with codes, in a named group.

    place is its number among its finish's variations, from 0. kind_fixes corrects kinds that were read wrong; name_fallbacks
    names variations, by kind and place, that have no name of their own in print. Else one without a name has its finish's.
    """
    of_groups, of_rows = cells(blocks, rules)
    joined = lambda c, by: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), labels.norm_text), by)
    described = labels.prose_text(F.coalesce("description", F.array().cast("array<string>")))
    heads = of_groups.select("page", "group", labels.fixed_up(joined("kind", ""), kind_fixes or {}).alias("kind"), described.alias("description")).where("kind != ''")
    texts = of_rows.select("page", "group", "row", joined("variation", "").alias("label"), joined("codes", ",").alias("raw"))
    split = texts.join(heads, ["page", "group"]).withColumn("split", labels.split_codes(F.col("raw"))).where(F.size("split.codes") > 0)
    split = split.withColumn("place", (F.row_number().over(Window.partitionBy("page", "group").orderBy("row")) - 1).cast("int"))
    name = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("kind"))
    for (k, place), instead in (name_fallbacks or {}).items():
        name = F.when((F.col("kind") == k) & (F.col("place") == place), F.lit(instead)).otherwise(name)
    clean = split.withColumn("clean", labels.clean_variation(name))
    return clean.select("page", "group", "row", "kind", "description", "place", F.col("clean.name").alias("name"), F.col("clean.methods").alias("methods"), F.col("split.codes").alias("numbers"), labels.note_text(F.col("raw")).alias("note"), F.col("split.rejected").alias("rejected"), "raw")


def nested(found: DataFrame) -> DataFrame:
    """(page, group, name, description, variations): one row per finish, its variations in print order."""
    each = F.struct("place", "name", "methods", F.col("numbers").alias("colorNumbers"), "note")
    out = found.groupBy("page", "group").agg(F.first("kind").alias("name"), F.first("description").alias("description"), F.array_sort(F.collect_list(each)).alias("v"))
    return out.select("page", "group", "name", "description", F.transform("v", lambda v: F.struct(v["name"].alias("name"), v["methods"].alias("methods"), v["colorNumbers"].alias("colorNumbers"), v["note"].alias("note"))).alias("variations"))


def rejected(found: DataFrame) -> DataFrame:
    """(page, group, finish, tokens, raw): what was no code, row by row."""
    return found.where(F.size("rejected") > 0).select("page", "group", "row", F.col("kind").alias("finish"), F.col("rejected").alias("tokens"), "raw")
