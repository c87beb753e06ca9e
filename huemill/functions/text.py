"""Titles, descriptions, addresses and structured data of published pages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head_list(items: Column, n: int, more: str = "ほか", joiner: str = "・") -> Column:
    """The first n items joined, with a mark where there are more."""
    return F.concat(F.array_join(F.slice(items, 1, n), joiner), F.when(F.size(items) > n, F.lit(more)).otherwise(F.lit("")))


def fit_sentences(sentences: Column, most: int) -> Column:
    """Sentences in order while they fit; one that doesn't is passed over, the first always stays."""
    step = lambda out, s: F.when((out != "") & (F.length(out) + F.length(s) > most), out).otherwise(F.concat(out, s))
    return F.aggregate(sentences, F.lit(""), step)


def finish_names(variations: Column) -> Column:
    return F.array_distinct(variations)


def size_span(shapes: Column) -> Column:
    """From the smallest to the largest of two measured shapes or more (structs with category, size, mm); else null."""
    kept = F.filter(shapes, lambda s: s["mm"] > 0)
    order = F.array_sort(F.transform(kept, lambda s, i: F.struct(s["mm"].alias("mm"), i.alias("i"), s["category"].alias("category"), s["size"].alias("size"))))
    lo, hi = F.try_element_at(order, F.lit(1)), F.try_element_at(order, F.lit(-1))
    return F.when(F.size(kept) >= 2, F.concat(lo["category"], lo["size"], F.lit("mm〜"), hi["category"], hi["size"], F.lit("mm")))


def title(brand: str, key: Column, family: Column, finishes: Column, series: Column) -> Column:
    traits = F.array_join(F.concat(finish_names(finishes), F.array(F.concat(family, F.lit("系")))), "・")
    return F.concat(F.lit(brand), F.coalesce(F.concat(F.lit(" "), series), F.lit("")), F.lit(" カラーNo."), key, F.lit("｜"), traits)


def description(brand: str, c: dict[str, Column], most: int = 155) -> Column:
    """Sentences about one colour, as many as fit. c: key, family, hex, words, finishes, series, types, codes, span, pages."""
    some = lambda items, text: F.when(F.size(items) > 0, text)
    words = F.when(F.size(c["words"]) > 0, F.concat(F.lit(" / "), F.array_join(c["words"], "・"))).otherwise(F.lit(""))
    types = F.concat(F.array_join(F.slice(c["types"], 1, 4), "・"), F.when(F.size(c["types"]) > 4, F.concat(F.lit("ほか計"), F.size(c["types"]), F.lit("種"))).otherwise(F.lit("")), F.lit("で展開。"))
    sentences = F.array_compact(
        F.array(
            F.concat(F.lit(f"{brand}のカラーNo."), c["key"], F.lit("（"), c["family"], F.lit("系 "), c["hex"], words, F.lit("）。")),
            some(c["finishes"], F.concat(F.lit("仕上げ加工は"), F.array_join(finish_names(c["finishes"]), "・"), F.lit("。"))),
            F.concat(F.lit("ガラス瓶を再生した"), c["series"], F.lit("の色です。")),
            some(c["types"], types),
            some(c["codes"], F.concat(F.lit("品番"), head_list(c["codes"], 3), F.lit("の価格つき。"))),
            F.concat(c["span"], F.lit("のサイズ比較。")),
            some(c["pages"], F.concat(F.lit("カタログ P."), F.array_join(F.transform(c["pages"], lambda p: p.cast("string")), "・"), F.lit("掲載。"))),
        )
    )
    return fit_sentences(sentences, most)


def address(base: str, *parts: Column) -> Column:
    """A URL below base, each part percent-encoded (a space as %20)."""
    return F.concat(F.lit(base.rstrip("/")), *(F.concat(F.lit("/"), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))) for p in parts))


def json_ld(kind: str, fields: dict[str, Column]) -> Column:
    """Structured data; fields that are null don't appear, and < is escaped for embedding in a page."""
    made = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *(c.alias(n) for n, c in fields.items())))
    return F.replace(made, F.lit("<"), F.lit("\\u003c"))


def _typed(kind: str, **fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *(c.alias(n) for n, c in fields.items()))


def website(base: str, name: str, text: Column, brand: str) -> Column:
    """Structured data of the site."""
    return json_ld("WebSite", {"@id": F.lit(f"{base.rstrip('/')}/#website"), "name": F.lit(name), "url": F.lit(f"{base.rstrip('/')}/"), "inLanguage": F.lit("ja"), "description": text, "about": _typed("Brand", name=F.lit(brand))})


def breadcrumb(trail: list[tuple[Column, Column]]) -> Column:
    """Structured data of the way to a page: names and addresses."""
    items = [_typed("ListItem", position=F.lit(k + 1), name=name, item=url) for k, (name, url) in enumerate(trail)]
    return json_ld("BreadcrumbList", {"itemListElement": F.array(*items)})


def product(c: dict[str, Column], brand: str, labels: dict[str, str]) -> Column:
    """Structured data of one colour. c: key, url, name, description, family, hex, finishes, types, codes, shapes (category, size), and
    image, which may be null; labels: what the properties key, family, hex, finishes, types and codes are called."""
    joined = lambda items: F.when(F.size(items) > 0, F.array_join(items, "・"))
    values = {"key": c["key"], "family": c["family"], "hex": c["hex"], "finishes": joined(finish_names(c["finishes"])), "types": joined(c["types"]), "codes": joined(c["codes"])}
    fixed = [F.when(v.isNotNull(), _typed("PropertyValue", name=F.lit(labels[k]), value=v)) for k, v in values.items()]
    sizes = F.transform(c["shapes"], lambda s: _typed("PropertyValue", name=s["category"], value=F.concat(F.lit("外径約"), s["size"], F.lit("mm"))))
    return json_ld(
        "Product",
        {
            "@id": F.concat(c["url"], F.lit("#product")), "name": c["name"], "url": c["url"], "image": c["image"], "description": c["description"], "color": c["family"], "material": F.lit("ガラス"),
            "brand": _typed("Brand", name=F.lit(brand)), "sku": F.when(F.size(c["codes"]) == 1, F.get(c["codes"], 0)), "additionalProperty": F.concat(F.array_compact(F.array(*fixed)), sizes),
        },
    )


def collection_page(base: str, url: Column, name: Column, text: Column, image: Column, items: Column) -> Column:
    """Structured data of a page with an array of (name, url)."""
    listed = F.transform(items, lambda x, i: _typed("ListItem", position=i + 1, name=x["name"], url=x["url"]))
    main = F.struct(F.lit("ItemList").alias("@type"), F.size(items).alias("numberOfItems"), listed.alias("itemListElement"))
    part = F.struct(F.lit(f"{base.rstrip('/')}/#website").alias("@id"))
    return json_ld("CollectionPage", {"@id": F.concat(url, F.lit("#page")), "name": name, "url": url, "description": text, "inLanguage": F.lit("ja"), "primaryImageOfPage": _typed("ImageObject", contentUrl=image), "isPartOf": part, "mainEntity": main})


def page_metadata(name: Column, text: Column, url: Column, image: Column) -> Column:
    return F.struct(name.alias("title"), text.alias("description"), url.alias("canonical"), F.struct(name.alias("title"), url.alias("url"), image.alias("image")).alias("card"))


def first_word(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def round_note(categories: Column) -> Column:
    """A note where the only round size is the small or the large one."""
    rounds = F.filter(categories, lambda c: c.isin("丸小ビーズ", "丸中ビーズ", "丸大ビーズ"))
    only = F.when(F.size(rounds) == 1, F.get(rounds, 0))
    return F.when(only == "丸小ビーズ", "丸小サイズのみの常備品です。").when(only == "丸大ビーズ", "丸大サイズのみの常備品です。")


def official_only(official: Column, printed: Column) -> Column:
    """Values of official that aren't empty and neither hold nor are held by a printed one."""
    return F.filter(official, lambda f: (f != "") & ~F.exists(printed, lambda p: p.contains(f) | f.contains(p)))


# The sentences of published pages.


def scan_title(source: str, brand: str, page: Column, lines: Column) -> Column:
    """Title of a scanned page: the edition, the page and its first two lines."""
    head = F.when(F.size(lines) > 0, F.concat(F.lit("｜"), head_list(lines, 2))).otherwise(F.lit(""))
    return F.concat(F.lit(source.split(" ")[0] + " P."), page, head, F.lit(f" | {brand}"))


def scan_description(source: str, page: Column, lines: Column, keys: Column, n_keys: Column) -> Column:
    """What a scanned page holds: its lines, and its first eight colours of n_keys."""
    more = F.when(n_keys > 8, F.concat(F.lit("ほか計"), n_keys.cast("string"), F.lit("色"))).otherwise(F.lit(""))
    listed = F.when(F.size(lines) > 0, F.concat(F.lit("掲載は"), F.array_join(lines, "・"), F.lit("。"))).otherwise(F.lit(""))
    colors = F.when(F.size(keys) > 0, F.concat(F.lit("カラーNo."), F.array_join(F.slice(keys, 1, 8), "・"), more, F.lit("が載っています。"))).otherwise(F.lit(""))
    return F.concat(F.lit(f"{source} "), page, F.lit("ページの誌面。"), listed, colors)


def guide_description(brand: str, n_finishes: Column, names: Column, groups: Column, n_types: Column) -> Column:
    """The guide's description: how many finishes and shapes it explains, the first of them by name."""
    return F.concat(
        F.lit(f"{brand}の仕上げ加工"), n_finishes.cast("string"), F.lit("種類（"), F.array_join(names, "・"), F.lit("ほか）と、"), F.array_join(groups, "・"), F.lit("など形状"), n_types.cast("string"),
        F.lit("種のサイズ一覧。丸小と丸大の違いや、カラーNo.末尾に付くL・D・Fなど記号の意味も解説します。"),
    )


def home_description(brand: str, n_colors: Column, n_finishes: Column) -> Column:
    """The home page's description."""
    return F.concat(
        F.lit(f"{brand}のグラスビーズ"), n_colors.cast("string"), F.lit("色のカラーチャート。カラーNo.・品番・仕上げ加工"), n_finishes.cast("string"),
        F.lit("種・ビーズ種別・色の呼び名で絞り込め、選んだ色に近い順にも並べ替えられます。丸小・丸大・特小のサイズ比較と価格・品番つき。"),
    )
