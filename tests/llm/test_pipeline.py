"""run() against a plain version of each stage on its own input, on the smallest tables."""

import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from huemill.llm import quality
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_quality import base
from tests.llm.test_similarity import brute as brute_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        if name == "packing":
            check_packing(before, rows)
            break
        assert after.columns == columns
        kept, had = {r.doc_id: r for r in rows}, [(r.doc_id, r.text) for r in before]
        if name == "quality rules":
            for d, t in had:
                b = base(t)
                if b[0] < 50 or 100 * b[4] > 50 * b[0]:
                    assert d not in kept
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            verdicts = {r.doc_id: r.kept for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id", "kept").collect()}
            assert set(kept) == {d for d, k in verdicts.items() if k}
            assert all(d not in kept for d, q in labels.items() if q == 0)
        elif name == "near duplicates":
            assert set(kept) == {c for _, _, c in brute_groups(had)}
        elif name == "benchmark decontamination":
            assert set(kept) == {r[0] for r in brute_hits(had, items, 10) if not r[5]}
        else:
            assert set(kept) == {d for d, _ in had}
            for d, t in had:
                for _, a, b in brute_spans(t):
                    assert re.search(r"[^0-9]", t[a:b]) is None or t[a:b] not in kept[d].text
                if not brute_spans(t) and not re.search("[0-9@]", t):
                    assert kept[d].text == t
                assert kept[d].n_chars == len(kept[d].text)
        docs, before = spark.createDataFrame(rows, after.schema), rows
    ids = lambda rs: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rs)
    assert ids(corpus_pipeline.run(spark, SF).collect()) == ids(rows)


def check_packing(docs, pieces):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, places = [], {}
    for r in docs:
        full = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        want += [(r.doc_id, s, len(full[s : s + 1024]), zlib.crc32(np.array(full[s : s + 1024], "<u4").tobytes())) for s in range(0, len(full), 1024)]
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(want)
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
