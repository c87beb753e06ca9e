"""Writers: nested documents, seeds that overwrite and live files that don't, capped reports, wanted images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(df: DataFrame, path: str) -> None:
    """One compact JSON document a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_prices(prices: DataFrame, seed_path: str, live_path: str, reseed: bool = False) -> None:
    """The seed always; the live layer, which people edit, only where it is absent or on reseed."""
    prices.write.mode("overwrite").json(seed_path)
    prices.write.mode("overwrite" if reseed else "ignore").json(live_path)


def write_colors(colors: DataFrame, path: str) -> None:
    """The colours of an extraction, by number and suffix."""
    write_documents(colors.orderBy("number", "suffix"), path)


def write_report(df: DataFrame, path: str, order: list[str], rows: int = 400) -> None:
    """The first rows of a report in order."""
    df.orderBy(*order).limit(rows).write.mode("overwrite").json(path)


def wanted_images(listing: DataFrame, *references: DataFrame) -> DataFrame:
    """Files of a listing (column image) that a reference names."""
    names = references[0].select("image")
    for r in references[1:]:
        names = names.union(r.select("image"))
    return listing.join(names.distinct(), "image", "left_semi")


def sitemap(base: str, *paths: DataFrame) -> DataFrame:
    """Addresses of several kinds of pages (column path), in the order given; repeats stay."""
    out = None
    for k, p in enumerate(paths):
        part = p.select(F.lit(k).alias("part"), "path", F.concat(F.lit(base.rstrip("/")), F.col("path")).alias("url"))
        out = part if out is None else out.unionByName(part)
    return out
