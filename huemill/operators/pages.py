"""Rows of pages and of the published catalogue: layouts, recovered labels, trimmed artwork, lookups, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huemill.names import fresh
from huemill.operators import raster
from huemill.session import materialised

# -- layout --------------------------------------------------------------------------------------


def on_chart_pages(df: DataFrame, pages: DataFrame, key: str = "page") -> DataFrame:
    """Rows of the listed pages, with what the list tells of them; rows of other pages go."""
    return df.join(pages, key)


def confident(df: DataFrame, least: float = 0.25, column: str = "conf") -> DataFrame:
    """Readings that are sure enough: 0.25 for print, 0.3 for recovered labels."""
    return df.where(F.col(column) >= least)


def regions(labels: DataFrame, margin: Column) -> DataFrame:
    """Candidate regions (page, cell_id, ord, x0, y0, x1, y1) of each label: to its right (0), if wide enough, and above it (1), if tall enough.

    labels: page, cell_id, x0, y0, x1, y1, col, next_col (null in the last column), pitch, ceiling.
    """
    right = (F.col("x1") + 1.5, F.col("y0") - 3.5, F.coalesce(F.col("next_col") - 3, margin), F.col("y1") + 3.5)
    above = (F.col("col") - 2, F.greatest(F.col("ceiling"), F.col("y0") - 1.05 * F.col("pitch")), F.col("col") + F.col("pitch") - 6, F.col("y0") - 1.5)
    box = lambda k, b: F.struct(F.lit(k).alias("ord"), *(c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), b, strict=True)))
    both = F.array(F.when(right[2] - right[0] >= 8, box(0, right)), F.when(above[3] - above[1] >= 10, box(1, above)))
    out = labels.select("page", "cell_id", F.inline(F.array_compact(both)))
    return out.where((F.col("x1") - F.col("x0") >= 4) & (F.col("y1") - F.col("y0") >= 3))


def chosen_layout(embedded: DataFrame, derived: DataFrame, page: str = "page") -> DataFrame:
    """Of each page the embedded rectangles, if they are no fewer than the derived ones, else the derived ones."""
    n = lambda df, c: df.groupBy(page).agg(F.count("*").alias(c))
    both = n(embedded, "n_embedded").join(n(derived, "n_derived"), page, "full")
    use = both.select(page, (F.coalesce("n_embedded", F.lit(0)) >= F.coalesce("n_derived", F.lit(0))).alias("use"))
    pick = lambda df, cond: df.join(use.where(cond).select(page), page, "left_semi")
    return pick(embedded, "use").unionByName(pick(derived, "not use"))


def orphan_groups(tokens: DataFrame, page: str = "page", x: str = "x", y: str = "cy", last: str = "token_id") -> DataFrame:
    """tokens with `group`: in order of column (30 wide, half-even) and y, a token joins the one before it if it is less than 34 aside and 0 to 22 below."""
    w = Window.partitionBy(page).orderBy(F.rint(F.col(x) / 30), y, last)
    down = F.col(y) - F.lag(y).over(w)
    joins = (F.abs(F.col(x) - F.lag(x).over(w)) < 34) & (down >= 0) & (down < 22)
    opens = fresh("opens", tokens)
    return tokens.withColumn(opens, (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("group", F.sum(opens).over(w)).drop(opens)


def probes(groups: DataFrame) -> DataFrame:
    """groups (with col, top, pitch) with the rectangle above them in which a lost label is looked for; too small ones go."""
    box = {"px0": F.col("col") - 5, "py0": F.col("top") - 17, "px1": F.col("col") + F.least(0.55 * F.col("pitch"), F.lit(60.0)), "py1": F.col("top") - 0.5}
    out = groups.withColumns(box)
    return out.where((F.col("px1") - F.col("px0") >= 6) & (F.col("py1") - F.col("py0") >= 5))


def recovered_labels(readings: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """Of each group's readings (columns label, conf, pos) the surest label; of equals the first."""
    sure = confident(readings, least).where("label is not null")
    return sure.groupBy(*keys).agg(F.max_by("label", F.struct("conf", -F.col("pos"))).alias("label"), F.max("conf").alias("conf"))


def finish_grid(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, low, high, group): rows of a finish table between consecutive horizontal rules, with the place of the group they are in.

    rules: page, orient, pos, a, b; pages: page, left, right, bottom, and var, the x of the second column. Horizontal rules that
    reach the right edge bound rows; those that start at the left edge bound groups too; the bottom bounds the last of both.
    """
    wide = rules.where("orient = 'h'").join(pages, "page").where((F.col("b") >= F.col("right") - 20) & (F.col("a") <= F.col("var") + 20))
    marks = wide.select("page", F.col("pos").alias("at"), (F.col("a") <= F.col("left") + 20).alias("opens"))
    marks = marks.unionByName(pages.select("page", F.col("bottom").alias("at"), F.lit(False).alias("opens")))
    marks = marks.groupBy("page", "at").agg(F.max("opens").alias("opens"))
    w = Window.partitionBy("page").orderBy("at")
    placed = marks.select("page", F.col("at").alias("low"), F.lead("at").over(w).alias("high"), F.sum(F.col("opens").cast("int")).over(w).alias("group"))
    return placed.where("high is not null")


def to_pixels(points: Column, dpi: int) -> Column:
    """Points (72 an inch) as whole pixels, half-even."""
    return F.bround(points * dpi / 72, 0).cast("int")


def trim(pixels: DataFrame, rects: DataFrame, pad: float = 0.6, img: str = "img", pool: int = 4) -> DataFrame:
    """(img, x0, y0, x1, y1): each image's rectangle tightened to its artwork, padded, within the rectangle; images without any are absent.

    The ground is the most frequent bin of colours; the artwork is the largest blob of pixels that are far from it, without the
    rules at its edges. No image is gathered anywhere.
    """
    size = pixels.groupBy(img).agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height")).where("width >= 3 and height >= 3")
    art = materialised(raster.foreground(pixels, raster.background(pixels, img), img).select(img, "x", "y"))
    boxes = materialised(raster.blob_boxes(art, size, img, pool))
    box = boxes.select(img, *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = F.col("x").between(F.col("bx0"), F.col("bx1") - 1) & F.col("y").between(F.col("by0"), F.col("by1") - 1)
    counts = art.join(box, img).where(inside).groupBy(img, "x").agg(F.count("*").alias("n"))
    columns = box.select("*", F.explode(F.sequence(F.col("bx0"), F.col("bx1") - 1)).alias("x")).join(counts, [img, "x"], "left")
    fill = columns.select(img, "x", (F.coalesce("n", F.lit(0)) / (F.col("by1") - F.col("by0"))).alias("share"))
    peeled = raster.edge_peel(fill, img, "x", "share")
    met = box.join(peeled, img).join(size, img).join(rects.select(img, *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1"))), img)
    sx, sy = (F.col("rx1") - F.col("rx0")) / F.col("width"), (F.col("ry1") - F.col("ry0")) / F.col("height")
    return met.select(
        img,
        F.greatest(F.col("rx0") + F.col("first") * sx - pad, "rx0").alias("x0"),
        F.greatest(F.col("ry0") + F.col("by0") * sy - pad, "ry0").alias("y0"),
        F.least(F.col("rx0") + (F.col("last") + 1) * sx + pad, "rx1").alias("x1"),
        F.least(F.col("ry0") + F.col("by1") * sy + pad, "ry1").alias("y1"),
    )


def usable_photos(photos: DataFrame) -> DataFrame:
    """Photos (columns width, height, corner) much wider than tall, on a light ground."""
    return photos.where((F.col("width") >= 3.5 * F.col("height")) & (F.col("corner") >= 215))


# -- the published catalogue ---------------------------------------------------------------------


def lookup(colors: DataFrame, key: str, column: str = "key", position: str = "pos") -> DataFrame:
    """The first row with a key; the filter reaches the scan."""
    return colors.where(F.col(column) == key).orderBy(position).limit(1)


def chips(colors: DataFrame) -> DataFrame:
    """What a chip shows of a colour."""
    return colors.select("key", "hex", "hue", "family")


def keys_of(df: DataFrame, column: str) -> DataFrame:
    """One row per page to be made."""
    return df.select(column).distinct().orderBy(column)


def colors_on(colors: DataFrame, appearances: DataFrame, page: Column) -> DataFrame:
    """Colours that appear on a page, once each."""
    return colors.join(appearances.where(F.col("page") == page).select("key"), "key", "left_semi")


def lines_on(appearances: DataFrame) -> DataFrame:
    """(page, line, place): the lines of each page in the order in which they first appear there."""
    first = appearances.groupBy("page", "line").agg(F.min("pos").alias("first"))
    return first.select("page", "line", F.row_number().over(Window.partitionBy("page").orderBy("first", "line")).cast("long").alias("place"))


def noted(variations: DataFrame) -> DataFrame:
    """Variations that have a note."""
    return variations.where(F.coalesce(F.col("note"), F.lit("")) != "")


def colors_per_variation(variations: DataFrame) -> DataFrame:
    """variations with the number of their colours."""
    return variations.withColumn("n_colors", F.size("numbers").cast("long"))


def types_of_lines(appearances: DataFrame) -> DataFrame:
    """(line, types): the types of all appearances of a line, in order."""
    return appearances.select("line", F.explode("types").alias("t")).groupBy("line").agg(F.array_sort(F.collect_set("t")).alias("types"))


def counters(documents: DataFrame, kept: DataFrame, seen: DataFrame) -> DataFrame:
    """(counter, n): colours, appearances that are kept, those that quality dropped, pages, codes."""
    made = lambda df, **of: df.agg(*(F.coalesce(n.cast("long"), F.lit(0)).alias(c) for c, n in of.items()))  # noqa: E731  each frame is read once
    counts = [
        made(documents, colors=F.count("*"), appearances=F.sum(F.size("appearances"))),
        made(seen, dropped=F.count_if(~F.col("good"))),
        made(kept, pages=F.countDistinct("page"), codes=F.countDistinct("code")),
    ]
    rows = [df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in df.columns)))) for df in counts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def pages_of(appearances: Column) -> Column:
    """Distinct pages of a colour's appearances, ascending."""
    return F.array_sort(F.array_distinct(F.transform(appearances, lambda a: a["page"])))


def shapes_by_size(shapes: Column) -> Column:
    """Shapes (category, size, mm) by measure, then category, then place."""
    order = F.array_sort(F.transform(shapes, lambda s, i: F.struct(s["mm"].alias("mm"), s["category"].alias("category"), i.alias("i"), s.alias("s"))))
    return F.transform(order, lambda x: x["s"])


def distinct_styles(colors: DataFrame, column: str = "styles") -> DataFrame:
    """All styles, in order."""
    return colors.select(F.explode(column).alias("style")).distinct().orderBy("style")


def with_photo_sizes(df: DataFrame, sizes: DataFrame, image: str = "image") -> DataFrame:
    """df with the width and height of its image, 0 where there is none."""
    out = df.join(sizes.select(image, "width", "height"), image, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("width", "height")})


def served(df: DataFrame, files: DataFrame, image: str = "image") -> DataFrame:
    """Rows whose image, under the name it is served by, is among the files."""
    name = F.concat(F.regexp_replace(image, r"\.[^.]*$", ""), F.lit(".webp"))
    return df.withColumn("served", name).join(files.select(F.col("name").alias("served")).distinct(), "served")


def strictly_mapped(value: Column, table: dict[str, str]) -> Column:
    """A value through a table; one that it lacks is an error."""
    m = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(m, value), F.raise_error(F.concat(F.lit("no entry for "), value)))
