"""What each page of a published catalogue shows, for all pages of a kind at once.

Parts of a page (documents, variants, neighbours, siblings) are stored once in buckets of the page's key, sorted
within them, in the shared folder. A bundle joins and groups the buckets where they lie: above the scans of the
stored parts there is no exchange, however many kinds of parts a page has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huemill.functions import color, text
from huemill.operators.audit import bounded_list
from huemill.session import shared_folder

#: Keys of a class of siblings, codes of a colour and colours of a scan that a page lists; the numbers beside them count all.
LISTED = 20


def stored(frames: dict[str, DataFrame], key: str, buckets: int) -> dict[str, DataFrame]:
    """The frames as bucketed tables; rows without a key belong to no page, and go."""
    out, mark = {}, uuid.uuid4().hex
    for name, df in frames.items():
        spark = df.sparkSession
        table = f"bundle_{mark}_{name}"
        df.where(F.col(key).isNotNull()).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(table)
        out[name] = spark.table(table)
    return out


def siblings(documents: DataFrame, key: str = "key", number: str = "number") -> DataFrame:
    """(key, siblings, n_siblings): of each colour the least LISTED other keys of its number, and how many there are."""
    classes = bounded_list(documents.select(number, key), [number], key, LISTED + 1, "keys")
    met = documents.select(key, number).join(classes, number)
    others = F.slice(F.filter("keys", lambda k: k != F.col(key)), 1, LISTED)
    return met.select(key, others.alias("siblings"), (F.col("n") - 1).alias("n_siblings"))


def codes_of(codes: DataFrame, key: str = "key", code: str = "code") -> DataFrame:
    """(key, codes, n_codes): of each colour the least LISTED codes, and how many there are."""
    return bounded_list(codes.select(key, code).distinct(), [key], code, LISTED, "codes").withColumnRenamed("n", "n_codes")


def on_scans(appearances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page, lines) in order of first appearance, and (page, keys, n_keys): the least LISTED colours of each page, and how many there are. appearances: page, key, line, pos."""
    first = appearances.groupBy("page", "line").agg(F.min("pos").alias("pos")).where("line IS NOT NULL")
    lines = first.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    keys = bounded_list(appearances.where("key IS NOT NULL").select("page", "key").distinct(), ["page"], "key", LISTED, "keys")
    return lines, keys.withColumnRenamed("n", "n_keys")


def color_pages(parts: dict[str, DataFrame], brand: str, base: str) -> DataFrame:
    """One row per colour: what its page shows, and its title, description and structured data.

    parts, by key and stored(): documents (number, hex, family, words, finishes, types, pages, official, printed, categories: one row a
    key), codes and siblings (as above), near (rank, near: few rows a key). Lists that a colour lacks are empty.
    """
    none = F.array().cast("array<string>")
    near = parts["near"].groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "near"))).alias("near"))
    met = parts["documents"].join(parts["codes"], "key", "left").join(near, "key", "left").join(parts["siblings"], "key", "left")
    met = met.withColumns({"codes": F.coalesce("codes", none), "n_codes": F.coalesce("n_codes", F.lit(0)), "near": F.transform("near", lambda x: x["near"])})
    at = text.address(base, F.lit("colors"), F.col("key").cast("string"))
    facts = {"key": F.col("key").cast("string"), "family": F.col("family"), "hex": F.col("hex"), "words": F.col("words"), "finishes": F.col("finishes"), "series": F.lit(None).cast("string"), "types": F.col("types"), "codes": F.col("codes"), "span": F.lit(None).cast("string"), "pages": F.col("pages")}
    rgb = color.rgb_of(F.col("hex"))
    return met.select(
        "key", "hex", "family", "siblings", "n_siblings", "near", "codes", "n_codes",
        color.contrast_ink(rgb["r"], rgb["g"], rgb["b"]).alias("ink"),
        text.official_only(F.col("official"), F.col("printed")).alias("official_only"),
        text.round_note(F.col("categories")).alias("round_note"),
        text.title(brand, F.col("key").cast("string"), F.col("family"), F.col("finishes"), F.lit(None).cast("string")).alias("title"),
        text.description(brand, facts).alias("description"),
        text.breadcrumb([(F.lit("色を探す"), F.lit(f"{base.rstrip('/')}/")), (F.concat(F.lit("カラーNo."), F.col("key").cast("string")), at)]).alias("breadcrumb"),
    )


def scan_pages(parts: dict[str, DataFrame], source: str, brand: str) -> DataFrame:
    """One row per scanned page: the pages around it, its lines in order of appearance, its first colours and their number, title and description.

    parts, by page and stored(): scans (previous, next: one row a page), lines and keys (as above).
    """
    met = parts["scans"].join(parts["lines"], "page", "left").join(parts["keys"], "page", "left")
    empty = F.array().cast(parts["keys"].schema["keys"].dataType)
    met = met.withColumns({"lines": F.coalesce("lines", F.array().cast("array<string>")), "keys": F.coalesce("keys", empty), "n_keys": F.coalesce("n_keys", F.lit(0))})
    names, page = F.transform("keys", lambda k: k.cast("string")), F.col("page").cast("string")
    return met.select("page", "previous", "next", "lines", "keys", "n_keys", text.scan_title(source, brand, page, F.col("lines")).alias("title"), text.scan_description(source, page, F.col("lines"), names, F.col("n_keys")).alias("description"))


def _beside(*rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def guide(types: DataFrame, variations: DataFrame, brand: str) -> tuple[DataFrame, DataFrame]:
    """Sections of the guide: (finish, variations, notes) of every finish, and one row with its title's counts and description.

    types: pos, group, key, name, a small ordered dimension; variations: finish, place, name, numbers, note.
    """
    line = lambda v: F.concat(v["name"], F.lit(" "), v["n"].cast("string"), F.lit("色"))
    kept = variations.select("finish", F.struct("place", "name", F.size("numbers").alias("n"), "note").alias("v"))
    sections = kept.groupBy("finish").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    noted = F.filter("vs", lambda v: F.coalesce(v["note"], F.lit("")) != "")
    sections = sections.select("finish", F.transform("vs", line).alias("variations"), F.transform(noted, lambda v: F.concat(v["name"], F.lit(": ※"), v["note"])).alias("notes"))
    finishes = variations.groupBy("finish").agg(F.min("first").alias("first")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("first", "finish"))), 1, 5), lambda x: x["finish"]).alias("names"), F.count("*").alias("n_finishes"))
    groups = types.groupBy("group").agg(F.min("pos").alias("pos")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "group"))), 1, 2), lambda x: x["group"]).alias("groups"))
    n_types = types.agg(F.count("*").alias("n_types"))
    one = _beside(finishes, groups, n_types)
    return sections, one.select("n_finishes", "n_types", text.guide_description(brand, F.col("n_finishes"), F.col("names"), F.col("groups"), F.col("n_types")).alias("description"))


def home(documents: DataFrame, prices: DataFrame, words: str = "words") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the home page: (key, codes) with each colour's codes between spaces, so that a code is found whole; (word, n) by frequency, of equals the first
    seen first; and one row of counts: colours, colours with a price, codes.

    documents: pos, key and an array of words; prices: code, color_key. Of a colour's codes the least LISTED are in the index.
    """
    codes = bounded_list(prices.where("color_key IS NOT NULL").distinct(), ["color_key"], "code", LISTED, "codes")
    index = codes.select(F.col("color_key").alias("key"), F.concat(F.lit(" "), F.array_join("codes", " "), F.lit(" ")).alias("codes"))
    found = documents.select("pos", F.posexplode(words).alias("at", "word")).groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first"))
    ranked = found.orderBy(F.desc("n"), "first").select("word", "n")
    counts = _beside(documents.agg(F.count("*").alias("colors")), prices.agg(F.countDistinct("color_key").alias("priced"), F.countDistinct("code").alias("codes")))
    return index, ranked, counts
