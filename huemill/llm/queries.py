"""One thin query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huemill.llm import decontaminate, fill_in_middle, packing, passage_dedup, pii, pseudo_likelihood, quality, sharding, similarity, suffix_dedup, token_counts, toxicity, vector_codes
from huemill.session import reachable

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = [f"shard-{k:04d}" for k in range(64)]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), limit=4096)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_documents(spark, sf_dir), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passage_dedup.remove_repeats(_documents(spark, sf_dir), size=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return sharding.assign_shards(docs, SHARDS, F.col("doc_id"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.find_hits(_documents(spark, sf_dir), benchmark, window=10))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_documents(spark, sf_dir)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), length=1024)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = pseudo_likelihood.score(docs, pseudo_likelihood.fit(docs))
    return scored.select("doc_id", "n_words", "n_known", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("mean_log_likelihood", 6).alias("mean_log_likelihood"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(_documents(spark, sf_dir), labels)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "toxic", "kept", F.round("score", 6).alias("score"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.groups(_documents(spark, sf_dir), size=5, percent=75)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transform(_documents(spark, sf_dir), plain_percent=10, spm_percent=20, seed=1))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_terms", F.transform("evidence", lambda e: e["doc_id"]).alias("evidence"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_codes.compress(vectors, parts=16, entries=64, rounds=2).drop("label")


def queries() -> dict[str, Query]:
    found = (op1_token_counts, op2_suffix_dedup, op3_substring_dedup, op4_sharding, op5_decontamination, op6_pii, op7_packing, op8_lm_scoring, op9_quality_rules, op10_ngram_jaccard_join, op11_fill_in_middle, op12_toxicity, op13_vector_codes)
    return {f.__name__: (lambda spark, sf_dir, f=f: f(reachable(spark), sf_dir)) for f in found}


OP5_SQL = r"""
WITH folded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
         FROM items, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS g(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT k FROM wins),
runs AS (SELECT d.doc_id, i, s.k, array_to_string(d.ws[i:i + s.k - 1], ' ') AS w FROM folded d, sizes s, unnest(generate_series(1, len(d.ws) - s.k + 1)) AS g(i)),
hits AS (SELECT doc_id, i, k, item_id FROM runs JOIN wins USING (k, w)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + k - 1)) AS g(p) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN cover USING (doc_id) LEFT JOIN met USING (doc_id)
"""


OP2_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT doc_id, i, md5_number(substr(h, 2 * i::INT + 1, 100)) AS w FROM t, unnest(range(greatest(0, len(h) // 2 - 49))) AS g(i)),
first AS (SELECT w, min(doc_id) AS first_doc FROM wins GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM wins JOIN first USING (w) WHERE first_doc < doc_id),
edges AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM
          (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edges) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before::INT + 1, 2 * (a - before)::INT), '' ORDER BY a) AS k FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0)::INT + 1))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM t, unnest(generate_series(1, len(ws) - 19)) AS g(i)),
later AS (SELECT doc_id, i FROM wins QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(generate_series(i, i + 19)) AS g(p)),
words AS (SELECT doc_id, p, ws[p] AS word FROM t, unnest(generate_series(1, len(ws))) AS g(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""


OP10_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g FROM t, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS x(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS us FROM t),
r AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (len(us) + 1) AS i, ('0x' || substr(h, 9, 8))::BIGINT % (len(us) + 1) AS j FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
             WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(us[1:least(i, j)], '') AS p, array_to_string(us[least(i, j) + 1:greatest(i, j)], '') AS m, array_to_string(us[greatest(i, j) + 1:], '') AS s FROM r)
SELECT doc_id, len(us)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """The codebooks and codes in plain joins and sums; distances of all parts to all entries are written out."""
    nearest = """SELECT id, g, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT x.id, x.g, b.e, sum((x.c - b.c) ** 2)::BIGINT AS d FROM x JOIN {book} b USING (g, k) GROUP BY 1, 2, 3) GROUP BY id, g"""
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"x AS MATERIALIZED (SELECT id, (p - 1) // (len(embedding) // {parts}) AS g, (p - 1) % (len(embedding) // {parts}) AS k, floor(256 * embedding[p]::DOUBLE)::BIGINT AS c FROM kept, unnest(generate_series(1, len(embedding))) AS s(p))",
        f"b0 AS MATERIALIZED (SELECT g, id - 1 AS e, k, c FROM x WHERE id <= {entries})",
    ]
    for r in range(rounds):
        near = nearest.format(entries=entries, book=f"b{r}")
        means = f"SELECT g, e, k, sum(c)::BIGINT AS s, count(*) AS n FROM x JOIN ({near}) USING (id, g) GROUP BY g, e, k"
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT g, e, k, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{r} LEFT JOIN ({means}) USING (g, e, k))")
    steps.append(f"a AS MATERIALIZED ({nearest.format(entries=entries, book=f'b{rounds}')})")
    steps.append("v AS (SELECT id, string_agg(lower(format('{:02x}', e)), '' ORDER BY g) AS code, sum(d)::BIGINT AS error FROM a GROUP BY id)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY g, e, k)) FROM b{rounds}) AS codebooks_sha256 FROM v JOIN kept USING (id)"


OP13_SQL = _codes_sql(16, 64, 2)


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": OP11_SQL, "op13_vector_codes": OP13_SQL, "op2_suffix_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op10_ngram_jaccard_join": OP10_SQL}
