"""Colour as Column expressions: RGB, HSV with hue families, OKLab, contrast ink, drawn heights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huemill.names import fresh

# Hue families with their upper bounds in degrees (the first one also starts at 345).
FAMILIES = [("レッド", 10), ("オレンジ", 45), ("イエロー", 70), ("グリーン", 160), ("ブルー", 250), ("パープル", 290), ("ピンク", 345), ("レッド", 361)]
ACHROMATIC = {"light": "ホワイト", "dark": "ブラック", "middle": "グレー"}
# The published OKLab matrices, linear sRGB to LMS and LMS' to Lab.
TO_LMS = [(0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)]
TO_LAB = [(0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766)]
# Pixels per millimetre, largest enlargement, scale of shapes measured by length.
PX_PER_MM, MAX_UPSCALE, LENGTHWISE_SCALE = 28, 1.25, 0.75
LENGTHWISE = ("竹ビーズ", "ツイスト", "スパイラル")


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b))))


def rgb_of(hex_color: Column) -> Column:
    """struct(r, g, b) of a #rrggbb string."""
    part = lambda at: F.conv(F.substring(F.ltrim(hex_color, F.lit("#")), at, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def with_metrics(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """df with hex, hue, sat, val and family: rounded half-even; the family goes by the unrounded hue.

    Each step is a column of its own, so that no part is repeated in the generated code.
    """
    names = df.columns
    out = df.withColumns({f"_{k}": F.col(c).cast("double") / 255 for k, c in zip("xyz", (r, g, b), strict=True)})
    out = out.withColumns({"_top": F.greatest("_x", "_y", "_z"), "_low": F.least("_x", "_y", "_z")})
    top, low = F.col("_top"), F.col("_low")
    out = out.withColumns({"_sat": F.when(top == low, 0.0).otherwise((top - low) / F.when(top == 0, 1.0).otherwise(top)), "_span": F.when(top == low, 1.0).otherwise(top - low)})
    out = out.withColumns({f"_{k}c": (top - F.col(f"_{k}")) / F.col("_span") for k in "xyz"})
    x, y, z = (F.col(f"_{k}c") for k in "xyz")
    out = out.withColumn("_turn", F.when(F.col("_x") == top, z - y).when(F.col("_y") == top, 2.0 + x - z).otherwise(4.0 + y - x) / 6.0)
    out = out.withColumn("_hue", F.when(top == low, 0.0).otherwise(F.col("_turn") - F.floor("_turn")) * 360)
    bounds = [end for _, end in FAMILIES[:-1]]
    place = sum(((F.col("_hue") >= end).cast("int") for end in bounds[1:]), (F.col("_hue") >= bounds[0]).cast("int"))
    family = F.get(F.array(*(F.lit(name) for name, _ in FAMILIES)), place)
    grey = F.when(top > 0.82, ACHROMATIC["light"]).when(top < 0.25, ACHROMATIC["dark"]).otherwise(ACHROMATIC["middle"])
    return out.select(
        *names,
        hex_of(F.col(r), F.col(g), F.col(b)).alias("hex"),
        F.rint("_hue").cast("int").alias("hue"),
        F.bround("_sat", 3).alias("sat"),
        F.bround("_top", 3).alias("val"),
        F.when(F.col("_sat") >= 0.12, family).otherwise(grey).alias("family"),
    )


def _linear(c: Column) -> Column:
    x = c.cast("double") / 255
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))


def oklab(r: Column, g: Column, b: Column) -> Column:
    """struct(L, a, b)."""
    rgb = [_linear(c) for c in (r, g, b)]
    lms = [F.cbrt(sum((k * c for k, c in zip(row[1:], rgb[1:], strict=True)), row[0] * rgb[0])) for row in TO_LMS]
    lab = [row[0] * lms[0] + row[1] * lms[1] + row[2] * lms[2] for row in TO_LAB]
    return F.struct(*(c.alias(n) for c, n in zip(lab, "Lab", strict=True)))


def with_lab(df: DataFrame, hex_color: str = "hex") -> DataFrame:
    """df with L, a and b of a #rrggbb column, for an index. Each step is a column of its own."""
    names = [c for c in df.columns if c not in ("L", "a", "b")]
    rgb, lin, lms = fresh("rgb", df), [fresh(f"linear_{c}", df) for c in "rgb"], [fresh(f"cone_{c}", df) for c in "lms"]
    out = df.withColumn(rgb, F.conv(F.ltrim(hex_color, F.lit("#")), 16, 10).cast("int"))
    out = out.withColumns({n: F.shiftright(rgb, shift).bitwiseAND(F.lit(255)).cast("double") / 255 for n, shift in zip(lin, (16, 8, 0), strict=True)})
    out = out.withColumns({n: F.when(F.col(n) <= 0.04045, F.col(n) / 12.92).otherwise(F.pow((F.col(n) + 0.055) / 1.055, 2.4)) for n in lin})
    weighed = lambda row, columns: row[0] * F.col(columns[0]) + row[1] * F.col(columns[1]) + row[2] * F.col(columns[2])
    out = out.withColumns({n: F.cbrt(weighed(row, lin)) for n, row in zip(lms, TO_LMS, strict=True)})
    return out.select(*names, *(weighed(row, lms).alias(n) for n, row in zip("Lab", TO_LAB, strict=True)))


def lab_of(hex_color: str) -> tuple[float, float, float]:
    """L, a and b of one colour."""
    n = int(hex_color.lstrip("#")[:6], 16)
    rgb = [(n >> shift & 255) / 255 for shift in (16, 8, 0)]
    lin = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in rgb]
    lms = [math.cbrt(sum(k * x for k, x in zip(row, lin, strict=True))) for row in TO_LMS]
    return tuple(sum(k * x for k, x in zip(row, lms, strict=True)) for row in TO_LAB)


def oklab_distance(x: Column, y: Column) -> Column:
    parts = [(x[k] - y[k]) * (x[k] - y[k]) for k in "Lab"]
    return F.sqrt(parts[0] + parts[1] + parts[2])


def contrast_ink(r: Column, g: Column, b: Column) -> Column:
    """A readable text colour on the colour."""
    return F.when((0.299 * r + 0.587 * g + 0.114 * b) / 255 > 0.62, "#1b1a19").otherwise("#ffffff")


def drawn_height(mm: Column, native: Column, category: Column) -> Column:
    """Pixels that a shape's photo is drawn high; rounded half up."""
    lengthwise = F.lit(False)
    for word in LENGTHWISE:
        lengthwise = lengthwise | category.contains(word)
    height = F.when(native == 0, 60).otherwise(native)
    scaled = F.when(lengthwise | (mm == 0), height * LENGTHWISE_SCALE).otherwise(F.least(mm * PX_PER_MM, height * MAX_UPSCALE))
    return F.floor(scaled + 0.5).cast("int")
