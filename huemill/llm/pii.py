"""Personal data in whole texts: patterns of fixed kinds, and identifiers that their contexts reveal.

Base spans are the leftmost non-overlapping matches of a pattern per kind, of which those that fail
a check (parts of an address, digits, Luhn's sum) are dropped without another try. They always stay.

Bootstrapping. The two words before an identifier, lower-cased, with digits as 0 and without opening
marks, are its pattern (of the REACH code points before it, whatever stands there); its text is the
instance. Seeds are the base spans, and for secrets, which have no base pattern, tokens that are long
hexadecimal strings. Tokens outside of base spans that hold a digit or an at sign are candidates for
the kinds whose make-up they have (PLAUSIBLE). On the graph of patterns and instances, in each round,
a pattern's confidence in a kind is the share of all its occurrences whose instance is of that kind,
among patterns with enough distinct instances; then every candidate instance next to a confident
pattern becomes one of the kind, which may raise other patterns. After the last round, candidates and
seeds of secrets behind confident patterns become spans of the kind.

Only DataFrame functions run. What is kept of a text (spans, candidates) is written to the shared
folder; patterns and instances are counted before they are shuffled. Null and empty texts have no
spans. Rows with the same id and text have the same spans. Offsets are in code points, ends
exclusive. redact() keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huemill.llm.common import fresh, shared_checkpoint

KINDS = ("email", "ip", "card", "phone")
#: All kinds, as spans are listed; a secret is found by its context alone.
ALL_KINDS = (*KINDS, "secret")
#: The base patterns; possessive, and tried at the start of a run only, so that long runs stay linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens between spaces and marks that hold a digit or an at sign.
CANDIDATE = r"(?<![^\s,;\"'<>()|])[^\s,;\"'<>()|0-9@]*+[0-9@][^\s,;\"'<>()|]*+"
#: Characters of a candidate at least.
SHORTEST = 6
#: What a candidate of a kind looks like as a whole.
PLAUSIBLE = {
    "email": r"^[^@]+@[^@]{3,}$",
    "ip": r"^[0-9]+[.:][0-9]+[.:][0-9]+[.:0-9]*$",
    "card": r"^[0-9][0-9./_-]{11,24}[0-9]$",
    "phone": r"^[+]?[0-9][0-9./_-]{5,18}[0-9]$",
    "secret": r"^(?=.*[a-z])[a-z0-9+/=_-]{16,}$",
}
#: What the seeds of secrets look like, in lower case.
SECRET = r"^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}$"
#: Code points before a span in which its pattern is looked for.
REACH = 60
#: Matches whose places are summed up at a time.
RUN = 256
#: Rounds of the bootstrapping, least confidence of a pattern, least distinct instances of a pattern.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 5
#: Discovered spans are broadcast up to so many; more are joined by a shuffle.
FEW_SPANS = 100_000

SPAN = "array<struct<start:int,end:int,text:string,pattern:string>>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits of s pass Luhn's sum."""
    d = F.transform(F.filter(F.split(F.reverse(_digits(s)), ""), lambda x: x != ""), lambda x: x.cast("int"))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"
    return {
        "email": F.lit(True),
        "ip": s.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": F.when(n.between(13, 19), _luhn(s)).otherwise(F.lit(False)),
        "phone": n.between(9, 15),
    }[kind]


def _pattern(before: Column) -> Column:
    """The last two words of a text, without opening marks after them."""
    ends = F.regexp_replace(F.regexp_replace(F.lower(before), "[0-9]", "0"), r"[\s\"'<(|]+$", "")
    words = F.filter(F.split(ends, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), words), -2, 2), " ")


def _sums_before(sizes: Column) -> Column:
    """The sum of all earlier numbers for each of a non-empty array; in runs, as an array that grows is copied each time."""
    empty = lambda: F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out"))
    within = lambda xs: F.aggregate(xs, empty(), step)
    runs = F.transform(F.sequence(F.lit(1), F.size(sizes), F.lit(RUN)), lambda k: within(F.slice(sizes, k, F.lit(RUN))))

    def joined(rs: Column) -> Column:
        bases = F.aggregate(rs, empty(), lambda a, r: step(a, r["sum"]), lambda a: a["out"])
        return F.flatten(F.zip_with(rs, bases, lambda r, base: F.transform(r["out"], lambda x: x + base)))

    return _let(runs, joined)


def matches(text: Column, pattern: str, valid) -> Column:
    """Leftmost non-overlapping matches that are valid, with their places; the texts between come from a split at the same pattern."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(m: Column) -> Column:
        def walk(g: Column) -> Column:
            def before(i: Column) -> Column:
                # a gap and a match have a code point at least, but for the first gap
                start = F.greatest(F.lit(0), i - REACH // 2)
                pieces = F.flatten(F.zip_with(F.slice(g, start + 1, i - start), F.slice(m, start + 1, i - start), lambda x, y: F.array(x, y)))
                return F.right(F.when(F.length(F.get(g, i)) >= REACH, F.get(g, i)).otherwise(F.concat(F.array_join(pieces, ""), F.get(g, i))), F.lit(REACH))

            def spans(sums: Column) -> Column:
                def span(s: Column, i: Column) -> Column:
                    start, t = s + F.length(F.get(g, i)), F.get(m, i)
                    return F.when(valid(t), F.struct(start.alias("start"), (start + F.length(t)).alias("end"), t.alias("text"), _pattern(before(i)).alias("pattern")))

                return F.array_compact(F.transform(sums, span))

            return _let(_sums_before(F.transform(m, lambda t, i: F.length(t) + F.length(F.get(g, i)))), spans)

        return F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(_let(gaps, walk)).cast(SPAN)

    return _let(found, place)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind."""
    text = F.coalesce(text, F.lit(""))
    sign = {"email": "@", "ip": ".", "phone": "+"}
    none = F.array().cast(SPAN)
    found = {k: matches(text, p, lambda s, k=k: _valid(k, s)) for k, p in PATTERNS.items()}
    return {k: F.when(text.contains(sign[k]), c).otherwise(none) if k in sign else c for k, c in found.items()}


def candidates(text: Column) -> Column:
    """Tokens that may be identifiers."""
    return matches(F.coalesce(text, F.lit("")), CANDIDATE, lambda s: F.length(s) >= SHORTEST)


def analysed(docs: DataFrame) -> DataFrame:
    """For each row: id, hash of the text, base spans by kind, candidates outside of them; in the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), *(c.alias(k) for k, c in base_spans(F.col("text")).items()), candidates(F.col("text")).alias("tokens"))
    clear = lambda t: ~F.exists(F.concat(*KINDS), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    return shared_checkpoint(read.withColumn("tokens", F.filter("tokens", clear)))


def _occurrences(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind (null: candidate), base (whether it is a base span), start, end, pattern, instance."""

    def rows_of(column: str, kind: Column) -> Column:
        return F.transform(column, lambda s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["pattern"].alias("pattern"), F.lower(s["text"]).alias("instance")))

    parts = [*(rows_of(k, F.lit(k)) for k in KINDS), rows_of("tokens", F.lit(None).cast("string"))]
    found = rows.select("doc_id", "text_hash", F.inline(F.concat(*parts))).withColumn("base", F.col("kind").isNotNull())
    return found.withColumn("kind", F.when(F.col("instance").rlike(SECRET) & ~F.col("base"), F.lit("secret")).otherwise(F.col("kind")))


def _plausible(occurrences: DataFrame) -> DataFrame:
    """Candidates by each kind they may be of."""
    kinds = F.array_compact(F.array(*(F.when(F.col("instance").rlike(p), F.lit(k)) for k, p in PLAUSIBLE.items())))
    return occurrences.where("kind is null").drop("kind").withColumn("kind", F.explode(kinds))


def confident_patterns(rows: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) after the last round."""
    occurrences = _occurrences(rows)
    key = ["pattern", "instance", "kind"]
    seeds = occurrences.where("kind is not null").groupBy(*key).agg(F.count("*").alias("n")).withColumn("seed", F.lit(True))
    maybe = _plausible(occurrences).groupBy(*key).agg(F.count("*").alias("n")).withColumn("seed", F.lit(False))
    edges = shared_checkpoint(seeds.unionByName(maybe))
    totals = occurrences.groupBy("pattern").agg(F.count("*").alias("total"))
    known = seeds.select("instance", "kind").distinct()
    patterns = None
    for _ in range(rounds):
        good = edges.where("seed").select(*key, "n").unionByName(edges.where("not seed").join(known, ["instance", "kind"], "left_semi").select(*key, "n"))
        scored = good.groupBy("pattern", "kind").agg(F.sum("n").alias("good"), F.countDistinct("instance").alias("instances")).where(F.col("instances") >= support)
        patterns = scored.join(totals, "pattern").withColumn("confidence", F.col("good") / F.col("total")).where(F.col("confidence") >= confidence)
        patterns = shared_checkpoint(patterns.select("pattern", "kind", "confidence"))
        met = edges.where("not seed").join(patterns, ["pattern", "kind"])
        best = met.groupBy("instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        known = shared_checkpoint(known.unionByName(best).distinct())
    return patterns


def discovered(rows: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """doc_id, text_hash and the spans found by context, one per candidate, of the kind with the most confident pattern."""
    patterns = confident_patterns(rows, rounds, confidence, support)
    place = ["doc_id", "text_hash", "start", "end"]
    occurrences = _occurrences(rows)
    met = _plausible(occurrences).unionByName(occurrences.where("kind is not null and not base")).join(patterns, ["pattern", "kind"])
    one = met.groupBy(*place).agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    spans = one.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("more"))
    return shared_checkpoint(spans)


def _with_discovered(rows: DataFrame, text_hash: str, more: DataFrame) -> tuple[DataFrame, str]:
    """rows and the spans found by context, an empty array where there are none; and the name of their column."""
    few = more.limit(FEW_SPANS + 1).select(F.sum(F.size("more"))).first()[0] or 0
    of, h, spans = (fresh(rows, c) for c in ("of", "hash", "more"))
    more = more.select(F.col("doc_id").alias(of), F.col("text_hash").alias(h), F.col("more").alias(spans))
    more = F.broadcast(more) if few <= FEW_SPANS else more
    both = rows.join(more, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(text_hash) == F.col(h)), "left").drop(of, h)
    return both.withColumn(spans, F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"))), spans


def _tagged(spans: Column | str, k: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))


def _of_kind(spans: Column | str, k: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == k)


def _named(spans: Column) -> Column:
    """kind:start:end of spans by kind, as listed, then start."""
    ordered = F.concat(*(F.array_sort(_of_kind(spans, k)) for k in ALL_KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """A row per row of docs: doc_id, text_hash, base and all: arrays of (start, end, kind)."""
    rows = analysed(docs)
    both, more = _with_discovered(rows, "text_hash", discovered(rows, rounds, confidence, support))
    base = F.concat(*(_tagged(k, k) for k in KINDS))
    return both.select("doc_id", "text_hash", base.alias("base"), F.concat(base, more).alias("all"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, all spans as a string, and the number of those that contexts added."""
    counts = [F.size(_of_kind("base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_found"))


def redact(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; spans that overlap become one, named by the first."""
    names, text_hash = docs.columns, fresh(docs, "text_hash")
    found = discovered(analysed(docs), rounds, confidence, support)
    text = F.coalesce(F.col("text"), F.lit(""))
    both, more = _with_discovered(docs.withColumn(text_hash, F.xxhash64(text)), text_hash, found)
    spans = F.array_sort(F.concat(*(_tagged(c, k) for k, c in base_spans(F.col("text")).items()), more))
    piece = "array<struct<start:int,end:int,kind:string>>"

    def merge(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(a) > 0) & (s["start"] < last["end"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(grown))).otherwise(F.array_append(a, s)).cast(piece)

    merged = F.aggregate(spans, F.array().cast(piece), merge)

    def cut(m: Column) -> Column:
        before = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
        parts = F.transform(m, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        last = F.try_element_at(m, F.lit(-1))["end"]
        return F.when(F.size(m) == 0, F.col("text")).otherwise(F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text))))

    return both.withColumn("text", _let(merged, cut)).select(*names)
