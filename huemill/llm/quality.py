"""Quality verdicts on whole documents: simple counts, and a hashed n-gram log-likelihood ratio.

The text is cut into runs of letters and digits and runs of other non-space characters. Its
unigrams and bigrams are hashed into a fixed number of cells. Two smoothed multinomials over the
cells are counted: one over a trusted target (labelled documents of good quality, at most
target_rows of them in expectation, picked by a hash of their id), one over all raw documents.
A document's score is the mean over its n-grams of log p_target(cell) - log p_raw(cell); it is
kept where the score reaches the threshold and neither the simple counts nor its words rule it out.

Toxic documents. Over labelled toxic and clean documents (at most target_rows of each in
expectation) the documents with each lower-cased run are counted. A run whose log-likelihood ratio
of toxic against clean reaches TOXIC_RATIO, by counts that chance does not explain (TOXIC_SURE),
gives a document away. A document is as toxic as its worst run, so length dilutes nothing. Labelled
toxic documents are no part of the trusted target.

Only DataFrame functions run. Raw counts are summed in each task before the shuffle, whose size
is cells x tasks, and the ratio table goes out as one array of fixed length; texts are never
shuffled. Null and empty texts have no words and fail. Repeated rows are judged alike. With no
trusted documents every ratio is 0, and with no toxic ones (or no column toxic) no word is toxic. Columns of the input are kept; result columns of the same
names are replaced. The 3-word windows of a text are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huemill.llm.common import fresh

CELLS = 16_384
#: Documents whose mean log ratio is lower than this are dropped.
THRESHOLD = -0.35
#: Bound on the labelled rows that make the target, in expectation.
TARGET_ROWS = 20_000
#: Least log ratio of a toxic word, and least G statistic of its counts.
TOXIC_RATIO, TOXIC_SURE = 3.0, 25.0
SPACES = r"[\x20\x09-\x0D]+"
RUNS = r"[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]++"
#: Bits for the place of a window in its text.
PLACE_BITS = 26
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once: a generator of one row, into which no later filter or project is folded.

    Folded into a lambda, the array that it walks would be made anew for each of its elements."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _windows(ws: Column) -> Column:
    """64-bit hashes of the 3-word windows of an array of words; null with fewer than four words."""
    return F.when(F.size(ws) > 3, F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))))


def repeated_words(h: Column) -> Column:
    """Words in 3-word windows, given by their hashes, that occur twice or more.

    The low bits of each hash and its place are sorted as one number. Equal hashes come side by side then, or with another
    between whose low bits are the same; the whole hashes decide.
    """
    low = (1 << PLACE_BITS) - 1
    place = lambda e: e.bitwiseAND(F.lit(low)).cast("int")

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(at, k - 1), F.lit(-3))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def twins(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(h, place(F.get(s, k))) == F.get(h, place(e)), F.lit(False))
        found = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1) | same(e, k - 2) | same(e, k + 2))
        return F.sort_array(F.transform(found, place))

    packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("long"))))
    return F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(_let(_let(packed, twins), covered))


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the simple counts."""
    names, ws, h, lines = df.columns, *(fresh(df, c) for c in ("words", "windows", "lines"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = _computed(_computed(df, {ws: words(text), lines: with_lines}), {h: _windows(F.col(ws))})
    counts = (
        F.size(ws).cast("long"),
        F.length(F.array_join(ws, "")).cast("long"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        repeated_words(F.col(h)),
    )
    return out.select(*names, *(c.alias(n) for n, c in zip(COUNTS, counts, strict=True)))


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUNS), F.lit(0))


def _grams(h: Column) -> Column:
    """Unigrams and bigrams of an array of hashes of runs: a bigram is the hash of two hashes."""
    two = F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
    return F.concat(h, F.when(F.size(h) > 1, two).otherwise(F.array().cast("array<long>")))


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _word(w: Column) -> Column:
    return F.xxhash64(F.lower(w))


def labelled(labels: DataFrame) -> DataFrame:
    """One row per labelled id: trusted (good quality and not toxic) and toxic; an id with several rows is good, or toxic, where one of them is."""
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("_good"), F.coalesce(F.bool_or(toxic == 1), F.lit(False)).alias("_toxic")
    )
    return said.select("_id", (F.col("_good") & ~F.col("_toxic")).alias("_trusted"), "_toxic")


def _sample(said: DataFrame, n: int, target_rows: int) -> DataFrame:
    """At most target_rows of the n ids in expectation, whatever the input."""
    return said.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(min(1.0, target_rows / max(1, n)) * 1_000_000))


def ratios(docs: DataFrame, labels: DataFrame, n: int = CELLS, target_rows: int = TARGET_ROWS, text_col: str = "text", id_col: str = "doc_id") -> list[float]:
    """log p_target - log p_raw of each cell; n rows reach the driver at most."""
    good = labelled(labels).where("_trusted").select("_id")
    n_good = good.count()
    if not n_good:
        return [0.0] * n
    target = _sample(good, n_good, target_rows).select("_id", F.lit(True).alias("_target"))
    both = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(target), F.col("_doc") == F.col("_id"), "left")
    # the outer form, as the other one has the cells computed once more for a filter
    found = both.select("_target", F.col("_text")).transform(lambda x: _computed(x, {"_hashes": _hashes(runs(F.col("_text")))})).select("_target", F.explode_outer(_grams(F.col("_hashes"))).alias("_gram"))
    cell = F.pmod("_gram", F.lit(n)).cast("int").alias("c")
    rows = found.groupBy(cell).agg(F.count("_target"), F.count(F.lit(1))).where("c is not null").collect()
    logs = []
    for k in (1, 2):
        counts = {r[0]: r[k] for r in rows}
        total = sum(counts.values()) + n
        logs.append([math.log((counts.get(c, 0) + 1) / total) for c in range(n)])
    return [a - b for a, b in zip(*logs, strict=True)]


def toxic_words(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, text_col: str = "text", id_col: str = "doc_id") -> list[int]:
    """Hashes of the words that give a document away as toxic: their log-likelihood ratio of labelled toxic against clean documents."""
    said = labelled(labels)
    n = {r["_toxic"]: r["count"] for r in said.groupBy("_toxic").count().collect()}
    if not n.get(True) or not n.get(False):
        return []
    picked = _sample(said.where("_toxic"), n[True], target_rows).unionByName(_sample(said.where("not _toxic"), n[False], target_rows))
    read = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(picked.select("_id", "_toxic")), F.col("_doc") == F.col("_id"))
    words_of = F.array_distinct(F.transform(runs(F.col("_text")), _word))
    sizes = {r["_toxic"]: r["count"] for r in read.groupBy("_toxic").count().collect()}
    bad, fine = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not fine:
        return []
    found = read.select("_toxic", F.explode_outer(words_of).alias("w")).groupBy("w").agg(F.count_if("_toxic").alias("a"), F.count_if(~F.col("_toxic")).alias("b")).where("w is not null and a > 0")
    both = F.col("a") + F.col("b")
    term = lambda x, size: F.when(x > 0, x * F.log(x * (bad + fine) / (both * size))).otherwise(F.lit(0.0))
    ratio = F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("b") + 0.5) / (fine + 1))
    sure = 2 * (term(F.col("a"), F.lit(bad)) + term(F.col("b"), F.lit(fine)))
    return sorted(r["w"] for r in found.where((ratio >= TOXIC_RATIO) & (sure >= TOXIC_SURE)).select("w").collect())


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n: int = CELLS, target_rows: int = TARGET_ROWS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with the simple counts, base_failed, toxic, score and kept."""
    table = ratios(docs, labels, n, target_rows, text_col, id_col)
    marks = toxic_words(docs, labels, target_rows, text_col, id_col)
    packed = F.split(F.lit(",".join(f"{x!r}" for x in table)), ",").cast("array<double>")  # folded to one literal
    ratio = lambda gram: F.get(packed, F.pmod(gram, F.lit(n)).cast("int"))

    def step(a: Column, h: Column) -> Column:
        pair = F.when(a["before"].isNull(), F.lit(0.0)).otherwise(ratio(F.xxhash64(a["before"], h)))
        return F.struct(h.alias("before"), (a["sum"] + ratio(h) + pair).alias("sum"))

    start = F.struct(F.lit(None).cast("long").alias("before"), F.lit(0.0).alias("sum"))
    mean = lambda hs: F.when(F.size(hs) > 0, F.aggregate(hs, start, step, lambda a: a["sum"]) / (2 * F.size(hs) - 1)).otherwise(F.lit(0.0))
    worst = lambda ws: F.exists(ws, lambda w: _word(w).isin(marks)) if marks else F.lit(False)
    out = docs.drop(*(c for c in docs.columns if c.lower() in (*COUNTS, "base_failed", "toxic", "score", "kept")))
    names, found, hashed = out.columns, fresh(out, "runs"), fresh(out, "hashes")
    out = _computed(_computed(out, {found: runs(F.col(text_col))}), {hashed: _hashes(F.col(found))})
    out = out.select(*names, worst(F.col(found)).alias("toxic"), mean(F.col(hashed)).alias("score"))
    out = with_counts(out, text_col).select(*names, *COUNTS, "toxic", "score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("toxic") & (F.col("score") >= threshold))
