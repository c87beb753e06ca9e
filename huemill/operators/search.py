"""Faceted search, exact keys, orders, paging and nearest colours over the colour index."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huemill.functions import color
from huemill.operators.audit import bounded_list
from huemill.session import broadcast_if_small, materialised

PAGE, PICKED_PAGE = 240, 120
#: Keys of a class of siblings that are listed.
SIBLINGS = 1_000
KEY = r"^([A-Z]*)([0-9]+)([A-Z]*)$"
INDEX_COLUMNS = {"key": "k", "number": "n", "suffix": "s", "hex": "hex", "hue": "hue", "sat": "sat", "val": "val", "family": "fam", "finishes": "f", "bead_types": "b", "styles": "y", "swatch": "sw", "source": "src", "words": "w", "recycled": "rg", "matte": "matte", "unverified": "unverified"}


@dataclass(frozen=True)
class SearchSpec:
    """The state of a search: facets (any within one, all across), text, picked colour, order, size of the page."""

    query: str = ""
    facets: dict[str, frozenset[str]] = field(default_factory=dict)  # fam, f, b, y, w
    matte_only: bool = False
    recycled_only: bool = False
    picked: str | None = None
    sort: str = "number"
    limit: int = PAGE

    def toggled(self, facet: str, value: str) -> SearchSpec:
        """With a value put into a facet, or taken out of it; back to the first page."""
        now = self.facets.get(facet, frozenset()) ^ {value}
        return replace(self, facets={**self.facets, facet: now}, limit=PAGE)

    def asked(self, query: str) -> SearchSpec:
        return replace(self, query=query, limit=PAGE)

    def picking(self, hex_color: str | None) -> SearchSpec:
        return replace(self, picked=hex_color, limit=PICKED_PAGE if hex_color else PAGE)

    def more(self) -> SearchSpec:
        return replace(self, limit=self.limit + PAGE)

    def reset(self) -> SearchSpec:
        return SearchSpec(sort=self.sort)

    def active(self) -> int:
        return sum(map(len, self.facets.values())) + self.matte_only + self.recycled_only + (self.picked is not None)


def color_index(colors: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The pruned view that searches read, with L, a and b of its colours, and more columns of one's own; absent word lists are empty."""
    out = [F.col(a).alias(b) for a, b in INDEX_COLUMNS.items() if a in colors.columns]
    view = colors.select(*out, *more)
    view = view.withColumn("w", F.coalesce("w", F.array().cast("array<string>"))) if "w" in view.columns else view
    return color.with_lab(view) if "hex" in view.columns else view


def normalised(query: str) -> str:
    return re.sub(r"[\s-]+", "", query.strip().upper())


def key_parts(key: Column) -> Column:
    """struct(prefix, number, suffix) of an upper-cased key; null where it isn't one."""
    k = F.upper(key)
    part = lambda i: F.regexp_extract(k, KEY, i)
    return F.when(k.rlike(KEY), F.struct(part(1).alias("prefix"), part(2).cast("decimal(38,0)").alias("number"), part(3).alias("suffix")))


def matches_key(key: Column, query: str) -> Column:
    """The number exactly and the letters as prefixes; a query that is no key by containment."""
    m = re.match(KEY, query)
    if not m:
        return F.upper(key).contains(query)
    parts = key_parts(key)
    same = (parts["number"] == F.lit(m[2]).cast("decimal(38,0)")) & F.startswith(parts["prefix"], F.lit(m[1])) & F.startswith(parts["suffix"], F.lit(m[3]))
    return F.coalesce(same, F.lit(False))


def holds(items: Column, query: str) -> Column:
    return F.exists(items, lambda x: F.upper(x).contains(query))


def predicate(spec: SearchSpec, codes: str | None = None) -> Column:
    """The whole filter; scalar facets come first, so they reach the scan. codes: a column with the colour's product codes."""
    out = F.lit(True)
    if spec.facets.get("fam"):
        out = out & F.col("fam").isin(*sorted(spec.facets["fam"]))
    if spec.matte_only:
        out = out & F.col("matte")
    if spec.recycled_only:
        out = out & F.col("rg")
    for name in ("f", "b", "y", "w"):
        if spec.facets.get(name):
            out = out & F.arrays_overlap(name, F.array(*map(F.lit, sorted(spec.facets[name]))))
    q = normalised(spec.query)
    if q:
        text = matches_key(F.col("k"), q) | holds(F.col("f"), q) | holds(F.col("w"), q)
        out = out & (text | F.coalesce(F.array_contains(codes, q), F.lit(False)) if codes else text)
    return out


def ordering(spec: SearchSpec, position: str = "k") -> list[Column]:
    """What a page is sorted by; with a picked colour the index has L, a and b."""
    if spec.picked:
        away = [F.col(c) - F.lit(x) for c, x in zip("Lab", color.lab_of(spec.picked), strict=True)]
        return [F.round(F.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2]), 9), F.col(position)]
    by = {"hue": [F.col("hue"), F.desc("sat")], "light": [F.desc("val")], "number": [F.col("n"), F.col("s")]}
    return [*by[spec.sort], F.col(position)]


def search(index: DataFrame, spec: SearchSpec, position: str = "k", codes: str | None = None) -> DataFrame:
    """One page: a filter, then the first rows in order without a full sort. With a picked colour there is a column distance, by which it is sorted."""
    found = index.where(predicate(spec, codes))
    if not spec.picked:
        return found.orderBy(*ordering(spec, position)).limit(spec.limit)
    found = found if "L" in found.columns else color.with_lab(found)
    names = [c for c in index.columns if c != "distance"]
    return found.select(*names, ordering(spec, position)[0].alias("distance")).orderBy("distance", position).limit(spec.limit)


# -- containment by an index of grams --------------------------------------------------------------

#: Characters of a gram.
GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct runs of size characters of an upper-cased text; of a shorter text the whole."""
    t = F.upper(text)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - size + 1))
    return F.array_distinct(F.transform(at, lambda i: F.substring(t, i, F.lit(size))))


def gram_index(rows: DataFrame, key: str, texts: list[str], size: int = GRAM) -> DataFrame:
    """(gram, key) of all texts (string or array columns) of each row, once each, by gram: written so, a search reads the files of its grams alone."""
    parts = [F.flatten(F.transform(c, lambda t: grams(t, size))) if rows.schema[c].dataType.typeName() == "array" else grams(F.col(c), size) for c in texts]
    each = F.array_distinct(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)))
    return rows.select(key, F.explode(each).alias("gram")).repartitionByRange("gram").sortWithinPartitions("gram", key)


def containing(index: DataFrame, key: str, query: str, size: int = GRAM) -> DataFrame:
    """(key): rows that have all grams of an upper-cased query in their texts. All that hold the query are among them; a look at the texts has to follow.

    A query shorter than a gram goes by the grams that begin with it, hold it, or are short texts: all of the index's grams that contain it.
    """
    if len(query) < size:
        return index.where(F.col("gram").contains(query)).select(key).distinct()
    wanted = sorted({query[i : i + size] for i in range(len(query) - size + 1)})
    met = index.where(F.col("gram").isin(wanted)).groupBy(key).agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(wanted)).select(key)


def text_search(rows: DataFrame, index: DataFrame, key: str, texts: list[str], query: str) -> DataFrame:
    """Rows one of whose texts holds the query, upper-cased; only rows that the index names are looked at."""
    q = normalised(query)
    found = F.lit(False)
    for c in texts:
        found = found | F.coalesce(holds(F.col(c), q) if rows.schema[c].dataType.typeName() == "array" else F.upper(c).contains(q), F.lit(False))
    return rows.join(broadcast_if_small(containing(index, key, q)), key, "left_semi").where(found)


#: About the volume of the sRGB gamut in OKLab.
GAMUT = 0.05


def nearest_colors(queries: DataFrame, colors: DataFrame, n: int, key: str = "k") -> DataFrame:
    """(key, near, rank, distance) of the n nearest colours of each query, by OKLab distance (9 decimals), then key; itself excluded.

    Rows of one colour are searched for once: of each colour the n + 1 least keys are kept. A colour meets those of its own
    and the adjacent cells of a grid over OKLab, whose width comes from the number of different colours, so that a sphere of
    it holds about 2n. A colour is done where its n + 1 nearest are nearer than the width; the others meet cells
    twice as wide, until the grid has the whole space in adjacent cells (which takes colours that have no n neighbours).
    """
    rgb = ["r", "g", "b"]
    lab = lambda df: df.withColumn("lab", color.oklab(*map(F.col, rgb)))
    least = Window.partitionBy(*rgb).orderBy("near")
    keys = colors.select(*rgb, F.col(key).alias("near")).withColumn("i", F.row_number().over(least)).where(F.col("i") <= n + 1)
    points = materialised(lab(keys.groupBy(*rgb).agg(F.sort_array(F.collect_list("near")).alias("keys"))).select("lab", "keys"))
    open_ = materialised(lab(queries.select(*rgb).distinct()))
    width, rounds = min(2.0, (2 * n * GAMUT / (4.19 * max(1, points.count()))) ** (1 / 3)), []
    while True:
        cell = lambda x, w=width: F.floor(F.col("lab")[x] / w)
        around = F.sequence(F.lit(-1), F.lit(1))
        spread = open_.select(*rgb, F.col("lab").alias("ql"), *(cell(x).alias(f"own_{x}") for x in "Lab"))
        for x in "Lab":
            spread = spread.withColumn("step", F.explode(around)).withColumn(f"c{x}", F.col(f"own_{x}") + F.col("step"))
        placed = points.select("lab", "keys", *(cell(x).alias(f"c{x}") for x in "Lab"))
        met = spread.join(placed, ["cL", "ca", "cb"]).select(*rgb, "keys", F.round(color.oklab_distance(F.col("ql"), F.col("lab")), 9).alias("distance"))
        # of each colour the nearest alone are shuffled and kept; equally far ones all
        near = met.withColumn("place", F.rank().over(Window.partitionBy(*rgb).orderBy("distance"))).where(F.col("place") <= n + 1)
        each = F.flatten(F.transform(F.collect_list(F.struct("distance", "keys")), lambda x: F.transform(x["keys"], lambda k: F.struct(x["distance"].alias("distance"), k.alias("near")))))
        lists = near.groupBy(*rgb).agg(F.slice(F.array_sort(each), 1, n + 1).alias("list"), F.count("*").alias("m"), F.max("distance").alias("far"))
        last = width >= 2.0
        sure = (F.col("m") > n) & (F.col("far") < width - 1e-6)
        lists = materialised((lists if last else lists.where(sure)).select(*rgb, "list"))
        rounds.append(lists)
        if not last:
            open_ = materialised(open_.join(lists, rgb, "left_anti"))
        if last or open_.isEmpty():
            break
        width = min(2.0, 2 * width)
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    asked = queries.select(key, *rgb).join(found, rgb)
    others = F.slice(F.filter("list", lambda x: x["near"] != F.col(key)), 1, n)
    return asked.select(key, F.posexplode(others).alias("rank", "x")).select(key, "x.near", (F.col("rank") + 1).alias("rank"), "x.distance")


def tone_classes(colors: DataFrame, key: str = "k", number: str = "n") -> DataFrame:
    """(number, keys, n): the keys of each number, once, in order; of a number with more than SIBLINGS keys the least, and how many there are."""
    return bounded_list(colors.select(number, key).distinct(), [number], key, SIBLINGS, "keys")


def tone_siblings(colors: DataFrame, key: str = "k", number: str = "n") -> DataFrame:
    """(key, number, others): each key and the number of its siblings. The siblings are the keys of its class but itself; classes aren't expanded into pairs."""
    n = colors.groupBy(number).agg(F.countDistinct(key).alias("others"))
    return colors.select(key, number).distinct().join(n, number).select(key, number, (F.col("others") - 1).alias("others"))


def sibling_pairs(colors: DataFrame, key: str = "k", numbers: tuple[str, ...] = ("n",)) -> DataFrame:
    """(key, sibling): each key with every other key of its number, which may be several columns; a null number has no siblings.

    The pairs of a number grow with the square of its keys. They are the output: a task streams them from a sorted merge, which spills, and no list of them is made.
    """
    others = colors.select(*numbers, F.col(key).alias("sibling")).hint("merge")
    return colors.select(*numbers, key).join(others, list(numbers)).where(F.col(key) != F.col("sibling")).select(key, "sibling")


def hue_bands(colors: DataFrame, n: int, usable: Column, position: str = "k") -> DataFrame:
    """The most saturated usable colour of each of n equal bands of hue; of a band without usable ones, of all. Hue 360 is in none."""
    banded = colors.withColumn("band", F.floor(F.col("hue") * n / 360).cast("int")).where(F.col("band") < n).withColumn("_poor", (~usable).cast("int"))
    best = banded.groupBy("band").agg(F.min_by(F.struct(*colors.columns), F.struct("_poor", -F.col("sat"), position)).alias("best"))
    return best.select("band", "best.*")


def page_neighbours(pages: DataFrame, page: str = "page") -> DataFrame:
    """Pages with the one before and after; for the pages of one catalogue."""
    w = Window.orderBy(page)
    return pages.withColumn("previous", F.lag(page).over(w)).withColumn("next", F.lead(page).over(w))
