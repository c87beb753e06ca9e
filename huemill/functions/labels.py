"""Product labels and codes as Column expressions: grammar, repair, tokens, code lists, sizes, suffix notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the label grammar.
SIZE_WORDS = ("特小", "丸小", "丸中", "丸大", "特大", "六角特小", "六角小", "六角大")
PREFIXES = ("WCR", "CRLL", "CRS", "CHS", "CRD", "CR", "CH", "TB", "BM", "PF", "DEMI", "M", "A", "α", "Q")
SUFFIX_LETTERS = "ABCDFHLMSU"
NOT_LABELS = ("2021", "1M", "0", "4964291")
REPAIRS = (("IO", "10"), ("IOLS", "1015"))
LETTER_DIGITS = ("LSBD", "1580")
# Fixed values of the token classes; names of single products are given by the caller.
STYLE_WORDS = ("バラ", "糸通し", "丸小", "丸中", "丸大", "特小", "特大")
UNITS = ("g", "kg", "m", "本", "粒", "パック", "束")
# Fixed values of the suffix notes.
TONES = {"L": "最も淡い", "A": "淡い", "B": "やや濃い", "C": "濃い", "D": "より濃い", "H": "最も濃い"}
METHODS = ("ラスター", "オーロラ", "着色", "PF", "蛍光")
GLYPHS = {"砡": "艶", "自色": "白色"}
FULL_DIGITS = "０１２３４５６７８９"

GRAMMAR = rf"^({'|'.join(SIZE_WORDS)})?\s*({'|'.join(PREFIXES)})?[-\s]?(PF)?[-\s]?([0-9]{{1,4}})([{SUFFIX_LETTERS}]{{0,3}})$"
CODE = r"^(?:PF)?[0-9]{1,4}[A-Z]{0,3}$"


def printed_number(n: Column, digits: int) -> Column:
    """A whole number with zeros before it up to a number of digits; a longer one stays whole, where lpad would cut it."""
    return F.when(n.isNotNull(), F.format_string(f"%0{digits}d", n.cast("long")))


def half_width_digits(text: Column) -> Column:
    return F.translate(text, FULL_DIGITS, "0123456789")


def _read(token: Column, raw: Column) -> Column:
    """The label that one spelling of a token gives, or null."""
    part = lambda k: F.regexp_extract(token, GRAMMAR, k)
    number = F.try_to_number(part(4), F.lit("9999")).cast("int")
    prefix = F.when(part(3) != "", F.concat_ws(" ", F.nullif(part(2), F.lit("")), F.lit("PF"))).otherwise(F.nullif(part(2), F.lit("")))
    label = F.struct(
        F.trim(raw).alias("raw"), F.nullif(part(1), F.lit("")).alias("size"), prefix.alias("prefix"), number.alias("number"), part(5).alias("suffix"), F.concat(number.cast("string"), part(5)).alias("key")
    )
    return F.when(token.rlike(GRAMMAR) & (number != 0), label)


def _let(value: Column, body) -> Column:
    """body(value) with the value made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_label(text: Column) -> Column:
    """struct(raw, size, prefix, number, suffix, key), or null: the first of the plain and the repaired spellings that reads as a label."""
    t = F.upper(F.regexp_replace(F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", ""), "[．　]", ""))
    t = half_width_digits(F.replace(t, F.lit("Α"), F.lit("α")))
    t = F.regexp_replace(F.trim(F.substring_index(t, "・", 1)), r"^[0O](?=-[0-9]{4}$)", "α")

    def read(t: Column) -> Column:
        first, *repaired = (_let(s, lambda s: _read(s, text)) for s in (t, *(F.translate(t, a, b) for a, b in REPAIRS)))
        furniture = (t == "") | t.isin(*NOT_LABELS) | t.rlike(r"[0-9]\s*(?:MM|CM|M|G|KG)$")
        return F.when(~furniture, F.coalesce(first, *(F.when(t.rlike("[0-9]"), r) for r in repaired)))

    return _let(t, read)


def parse_label_loose(text: Column) -> Column:
    """As parse_label, or the last of two to four words of a short caption."""
    t = F.trim(text)
    words = F.split(t, r"\s+")
    caption = F.size(words).between(2, 4) & (F.length(t) <= 24)
    return F.coalesce(parse_label(text), F.when(caption, parse_label(F.try_element_at(words, F.lit(-1)))))


def bracketed(text: Column) -> Column:
    """The values of a 「a」「b」 string."""
    return F.regexp_extract_all(text, F.lit("「([^」]*)」"), F.lit(1))


def classify_token(token: Column, more_styles: tuple[str, ...] = ()) -> Column:
    """struct(kind, value) of a printed token: price, productCode, jan, quantity, style; the first that fits; else null."""
    price = r"^([0-9,]+)\s*円$"
    styled = F.lit(False)
    for w in (*STYLE_WORDS, *more_styles):
        styled = styled | token.contains(w)
    of = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return (
        F.when(token.rlike(price), of("price", F.replace(F.regexp_extract(token, price, 1), F.lit(","), F.lit(""))))
        .when(token.rlike(r"^[0-9]{6}$"), of("productCode", token))
        .when(token.rlike(r"^4964291[-\s]?[0-9]{6}$"), of("jan", F.regexp_replace(token, r"[-\s]", "")))
        .when(token.rlike(rf"^約?[0-9.,]+\s*(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})"), of("quantity", token))
        .when(styled & ~token.rlike("[0-9]"), of("style", token))
    )


def tokens_of(text: Column, x0: Column, x1: Column) -> Column:
    """array(struct(token, x0, x1)): a block cut at single spaces, each token's range by its offset; "123 円" is one token."""
    glued = F.regexp_replace(text, r"(?<=[0-9,])\s+(?=円)", "")
    parts = F.split(glued, " ")
    n = F.greatest(F.length(glued), F.lit(1))
    span = F.greatest(x1 - x0, F.lit(1e-6))
    offset = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, w: a + F.length(w) + 1)
    made = F.transform(parts, lambda w, i: F.struct(w.alias("token"), (x0 + span * offset(i) / n).alias("x0"), (x0 + span * (offset(i) + F.length(w)) / n).alias("x1")))
    return F.filter(made, lambda t: t["token"] != "")


def digit_width(code: Column) -> Column:
    return F.length(F.regexp_extract(code, r"^[^0-9]*([0-9]*)", 1))


def unglue(token: Column, widths: Column) -> Column:
    """The first cut of a token into two codes with as many digits each, a number of digits that the row has elsewhere; else null."""
    at = F.sequence(F.lit(1), F.greatest(F.length(token) - 1, F.lit(1)))
    cuts = F.transform(at, lambda i: F.array(F.substring(token, F.lit(1), i), F.substring(token, i + 1, F.length(token))))
    fits = lambda c: F.get(c, 0).rlike(CODE) & F.get(c, 1).rlike(CODE) & (digit_width(F.get(c, 0)) == digit_width(F.get(c, 1))) & F.array_contains(widths, digit_width(F.get(c, 0)))
    return F.get(F.filter(cuts, fits), 0)


def split_codes(raw: Column) -> Column:
    """struct(codes, rejected) of a printed run of codes; what follows ※ is a note."""
    head = F.translate(F.substring_index(raw, "※", 1), "，、．", ",,,")
    tokens = F.filter(F.transform(F.split(F.regexp_replace(head, r"[.\s]+", ","), ","), lambda t: F.regexp_replace(F.upper(F.trim(t)), r"(?<=[0-9])O", "0")), lambda t: t != "")
    widths = F.transform(F.filter(tokens, lambda t: t.rlike(CODE)), digit_width)
    judged = F.transform(tokens, lambda t: F.struct(t.alias("t"), t.rlike(CODE).alias("ok"), F.when(~t.rlike(CODE), unglue(t, widths)).alias("pair")))
    codes = F.flatten(F.transform(judged, lambda j: F.when(j["ok"], F.array(j["t"])).otherwise(F.coalesce(j["pair"], F.array().cast("array<string>")))))
    note = lambda j: F.when(j["pair"].isNull(), j["t"]).otherwise(F.concat(j["t"], F.lit("→"), F.array_join(j["pair"], ",")))
    return F.struct(codes.alias("codes"), F.transform(F.filter(judged, lambda j: ~j["ok"]), note).alias("rejected"))


def note_text(raw: Column) -> Column:
    """The parts after each ※, joined; null without one."""
    parts = F.split(raw, "※")
    return F.when(F.size(parts) > 1, F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.trim(p)), "；"))


def clean_variation(name: Column) -> Column:
    """struct(name, methods): legend marks stripped; methods that the name holds, in table order."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, "[®©™①-⑳]", ""), r"の(?=$|[（(])", ""))
    return F.struct(bare.alias("name"), F.filter(F.array(*map(F.lit, METHODS)), lambda m: bare.contains(m)).alias("methods"))


def norm_text(text: Column) -> Column:
    for a, b in GLYPHS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fixed_up(code: Column, fixes: dict[str, str]) -> Column:
    """A code or name through a table of corrections."""
    if not fixes:
        return code
    table = F.create_map(*(F.lit(x) for pair in fixes.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), code)


def prose_text(pieces: Column) -> Column:
    """Lines joined as they read; ・ between a line that ends in a letter or digit and one that starts with a digit."""
    join = lambda out, p: F.concat(out, F.when((out != "") & out.rlike("[0-9A-Za-z]$") & p.rlike("^[0-9]"), F.lit("・")).otherwise(F.lit("")), p)
    return F.aggregate(F.transform(pieces, norm_text), F.lit(""), join)


def size_mm(size: Column) -> Column:
    """Millimetres of a size label: the mean of a range, 0 where it isn't numbers."""
    parts = F.filter(F.split(size, "[〜～~]"), lambda p: F.trim(p) != "")
    values = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    bad = (F.size(values) == 0) | F.exists(values, lambda v: v.isNull())
    return F.when(size.isNull() | bad, 0.0).otherwise(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def tone_label(suffix: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in TONES.items() for x in pair))
    return F.try_element_at(table, F.nullif(F.regexp_extract(suffix, "[LABCDH]", 0), F.lit("")))


def suffix_notes(suffix: Column) -> Column:
    tone = F.concat(F.lit("色調: "), tone_label(suffix))
    matte = F.when(suffix.endswith("FM"), "FM: 着色またはパールのつや消し加工（つや消しが強い）").when(suffix.endswith("F"), "F: つや消し（frosted）加工")
    silver = F.when(suffix.contains("S"), "S: 銀メッキ系の同色番")
    double = F.when(suffix.contains("U"), "U: ダブルスリーカット系の同色番")
    return F.array_compact(F.array(tone, matte, silver, double))


def served_name(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(".webp"))


def local_name(path: Column) -> Column:
    return F.replace(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit("_"))
