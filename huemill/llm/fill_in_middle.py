"""Fill-in-middle transformation of whole texts by escaped marker injection.

A text is a sequence of units: runs of ASCII letters, and single other code points. A delimiter that
occurs in the text is escaped, and appended after each unit by one regexp_replace. The delimiters
count the units; substring_index takes the parts before, between and after two ranked delimiters,
from which delimiters and escapes are taken out again. The parts are put together with sentinels in
the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm), or the text is left plain.
Cuts and form come from a SHA-256 of the seed and the document's id, so that they depend neither on
partitions nor on the other rows.

Only DataFrame functions run and nothing is shuffled. A null text is empty, and empty texts are
plain; so are texts that contain a sentinel, as they could not be taken apart again. A null id hashes
as the empty string. Repeated rows are transformed alike. Columns of the input are kept; result
columns of the same names are replaced. A task needs some six times the size of its longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huemill.llm.common import fresh

#: Appended after each unit; begins an escape; what follows it for either of the two.
DELIMITER, ESCAPE = "\x01", "\x02"
DELIMITER_CODE, ESCAPE_CODE = "1", "2"
#: A run of letters, an escaped code point, any other code point.
UNIT = r"[A-Za-z]++|\x02[12]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ("n", "form", "prefix", "middle", "suffix", "output")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE_CODE)), F.lit(DELIMITER), F.lit(ESCAPE + DELIMITER_CODE))


def unescaped(part: Column) -> Column:
    """A part of a marked text without its delimiters, as it was. Every escape has its code behind it, so that neither replacement makes or breaks one of the other."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + DELIMITER_CODE), F.lit(DELIMITER)), F.lit(ESCAPE + ESCAPE_CODE), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), UNIT, "$0" + DELIMITER)


def units(mark: Column) -> Column:
    """Units of a marked text."""
    return (F.octet_length(mark) - F.octet_length(F.replace(mark, F.lit(DELIMITER), F.lit("")))).cast("long")


def fields(mark: Column, count: Column) -> Column:
    """The first count fields of a marked text, or the last -count."""
    return F.call_function("substring_index", mark, F.lit(DELIMITER), count.cast("int"))


def parts(mark: Column, n: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """Units up to low, from there up to high, and the rest, as they were in the text."""
    return unescaped(fields(mark, low)), unescaped(fields(fields(mark, high), low - high)), unescaped(fields(mark, high - n - 1))


def hashed(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from a SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (units), form, prefix, middle and suffix (null where the form is plain) and output.

    plain_percent of the documents stay as they are; of the others spm_percent have the form spm.
    """
    df = docs.drop(*(c for c in docs.columns if c.lower() in RESULTS and c not in (id_col, text_col)))
    names = [c for c in df.columns if c.lower() not in RESULTS]
    text, mark, low, high, a, b, c, d = (fresh(df, x) for x in ("text", "mark", "low", "high", "h1", "h2", "h3", "h4"))
    n, form = fresh(df, "n"), fresh(df, "form")
    pre, mid, suf = (fresh(df, x) for x in ("prefix", "middle", "suffix"))
    column = F.col
    out = df.withColumns({text: F.coalesce(column(text_col), F.lit("")), **dict(zip((a, b, c, d), hashed(column(id_col), seed), strict=True))})
    out = out.withColumn(mark, marked(column(text)))
    out = out.withColumn(n, units(column(mark)))
    kept = (column(text) == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (column(c) % 100 >= 100 - plain_percent)
    cuts = [column(x) % (column(n) + 1) for x in (a, b)]
    out = out.withColumns({low: F.least(*cuts), high: F.greatest(*cuts), form: F.when(kept, "plain").when(column(d) % 100 < spm_percent, "spm").otherwise("psm")})
    made = parts(column(mark), column(n), column(low), column(high))
    out = out.withColumns({x: F.when(column(form) != "plain", p) for x, p in zip((pre, mid, suf), made, strict=True)})
    whole = (
        F.when(column(form) == "psm", F.concat(F.lit(PREFIX), pre, F.lit(SUFFIX), suf, F.lit(MIDDLE), mid))
        .when(column(form) == "spm", F.concat(F.lit(SUFFIX), suf, F.lit(PREFIX), pre, F.lit(MIDDLE), mid))
        .otherwise(column(text))
    )
    return out.select(*names, column(n).alias("n"), column(form).alias("form"), column(pre).alias("prefix"), column(mid).alias("middle"), column(suf).alias("suffix"), whole.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from a transformed document and its form alone. Sentinels are in no part, and none can arise where a part meets one."""

    def apart(first: str, second: str) -> list[Column]:
        rest = F.substring(output, len(first) + 1, 2**31 - 1)
        one = F.call_function("substring_index", rest, F.lit(second), F.lit(1))
        tail = F.substring(rest, F.length(one) + len(second) + 1, F.lit(2**31 - 1))
        two = F.call_function("substring_index", tail, F.lit(MIDDLE), F.lit(1))
        return [one, two, F.substring(tail, F.length(two) + len(MIDDLE) + 1, F.lit(2**31 - 1))]

    pre, suf, mid = apart(PREFIX, SUFFIX)
    suf2, pre2, mid2 = apart(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(pre, mid, suf)).when(form == "spm", F.concat(pre2, mid2, suf2)).otherwise(output)


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per transformed document: sizes of its parts, hashes of its output and of the text rebuilt from it."""
    return out.select(
        F.col(id_col).alias("doc_id"),
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
