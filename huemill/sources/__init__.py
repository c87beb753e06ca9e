"""Readers with explicit schemas: positioned text, page geometry, product indexes, price maps, listings, image headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OCR = "array<struct<t:string,conf:double,x:double,y:double,w:double,h:double>>"
INDEX = "struct<item:array<struct<c_n:string,img:string,c:string,fin:string,cat:string,ttl:string,size:string,rmk:string>>>"
PRICES = "map<string,struct<colorKey:string,line:string,style:string,quantity:string,price:int,catalogPage:int>>"


def whole_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, doc) of JSON files, one document a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("doc"))


def ocr_blocks(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """Blocks of files pNN.json, scaled from 0..1 to the page (columns page, width, height); block_id is the place in the file."""
    raw = whole_files(spark, path, OCR).select(F.regexp_extract("path", r"p(\d+)\.json$", 1).cast("int").alias("page"), F.posexplode("doc").alias("block_id", "b"))
    at = lambda c: F.col(f"b.{c}")
    x0, y0, x1, y1 = at("x") * F.col("width"), at("y") * F.col("height"), (at("x") + at("w")) * F.col("width"), (at("y") + at("h")) * F.col("height")
    out = raw.join(pages, "page").select("page", "block_id", at("t").alias("text"), at("conf").alias("conf"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return out.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)


def rules(shapes: DataFrame, min_h: float = 50, min_v: float = 20, thin: float = 1.5) -> DataFrame:
    """Horizontal and vertical rules (page, orient, pos, a, b) of thin shapes (page, x0, y0, x1, y1); equal ones once, one decimal."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    one = lambda c: F.bround(c, 1)
    flat = shapes.where((h <= thin) & (w >= min_h)).select("page", F.lit("h").alias("orient"), one("y0").alias("pos"), one("x0").alias("a"), one("x1").alias("b"))
    tall = shapes.where((w <= thin) & (h >= min_v)).select("page", F.lit("v").alias("orient"), one("x0").alias("pos"), one("y0").alias("a"), one("y1").alias("b"))
    return flat.union(tall).distinct()


def swatch_rects(rects: DataFrame, pages: DataFrame, most: float = 0.85, least: float = 4) -> DataFrame:
    """Embedded images without those that fill the page and the tiny ones."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return rects.join(pages, "page").where((w * h <= most * F.col("width") * F.col("height")) & (w >= least) & (h >= least)).select(*rects.columns)


def flattened_pages(rects: DataFrame, pages: DataFrame, most: float = 0.85) -> DataFrame:
    """(page, flattened): whether one image fills the page."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return rects.join(pages, "page").groupBy("page").agg(F.bool_or(area > most * F.col("width") * F.col("height")).alias("flattened"))


def product_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of {"item": [...]} documents with their place: a document a file or, with lines, a line, as write_documents writes them. Many documents come as lines, as each file costs a listing and an opening."""
    docs = spark.read.schema("value string").text(path).select(F.from_json("value", INDEX).alias("doc")) if lines else whole_files(spark, path, INDEX)
    return docs.select(F.posexplode("doc.item").alias("pos", "r")).select("pos", "r.*")


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of a path that may be absent: then none. Asked through Hadoop's file system, so any store will do."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path, multiLine=True) if there else spark.createDataFrame([], schema)


def price_map(spark: SparkSession, path: str) -> DataFrame:
    """The price layer, a map by code, as rows. Codes stay strings."""
    return whole_files(spark, path, PRICES).select(F.explode("doc").alias("code", "e")).select("code", "e.*")


def rendered_pages(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of the files pNN.webp below path, ascending; contents aren't read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "p*.webp").load(path).select("path")
    n = F.regexp_extract("path", r"/p(\d+)\.webp$", 1)
    return names.where(n != "").select(n.cast("int").alias("page")).orderBy("page")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested documents, one JSON document a line, as write_documents writes them."""
    return spark.read.schema("value string").text(path).select(F.from_json("value", schema).alias("d")).select("d.*")


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small table of a catalogue (types, pages, styles, shapes, bottles) that people edit: CSV with a header, under a schema."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def printed_codes(text: DataFrame, column: str = "text") -> DataFrame:
    """(code, pos): upper-cased tokens between white space, the first place of each; pos is the place in its row."""
    tokens = text.select(F.posexplode(F.filter(F.split(F.upper(column), r"\s+"), lambda t: t != "")).alias("pos", "code"))
    return tokens.groupBy("code").agg(F.min("pos").alias("pos")).orderBy("pos")


def bottle_items(bottles: DataFrame) -> DataFrame:
    """A row per bottle and item of its array, both with their places."""
    return bottles.select("*", F.posexplode("items").alias("item_pos", "item")).drop("items")


def webp_size(content: Column) -> Column:
    """struct(width, height) of a WebP header (extended, lossless or lossy); null for anything else."""
    text = lambda at, n: F.decode(F.substring(content, at + 1, n), "ISO-8859-1")
    byte = lambda at: F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("bigint")
    little = lambda at, n: sum((byte(at + k) * (1 << 8 * k) for k in range(1, n)), byte(at))
    low14 = lambda c: c.bitwiseAND(F.lit(0x3FFF))
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    kind = text(12, 4)
    found = (
        F.when(kind == "VP8X", size(little(24, 3) + 1, little(27, 3) + 1))
        .when(kind == "VP8L", size(low14(little(21, 4)) + 1, low14(F.shiftright(little(21, 4), 14)) + 1))
        .when(kind == "VP8 ", size(low14(little(26, 2)), low14(little(28, 2))))
    )
    return F.when((F.length(content) >= 30) & (text(0, 4) == "RIFF") & (text(8, 4) == "WEBP"), found)
