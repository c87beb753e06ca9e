import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from huemill.llm import sharding as sh


def turns(shards, size):
    """The table by the definition: a full preference list for each shard, and turns."""
    prefs = []
    for s in shards:
        d = hashlib.md5(s.encode()).hexdigest()
        a, b = int(d[:16], 16) % size, int(d[16:], 16) % (size - 1) + 1
        prefs.append([(a + j * b) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for k, p in enumerate(prefs):
            if len(owner) < size:
                owner[next(s for s in p if s not in owner)] = k
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("n,size", [(1, 7), (3, 7), (5, 101), (7, 7)])
def test_table(n, size):
    names = [f"s{k}" for k in range(n)]
    assert sh.fill_table(names, size) == turns(names, size)


def test_table_is_even_and_stable():
    names = [f"s{k}" for k in range(20)]
    a, b = sh.fill_table(names, 10_007), sh.fill_table(names[:-1], 10_007)
    counts = Counter(a).values()
    assert max(counts) - min(counts) <= 1
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 19)
    assert moved < 0.05 * 10_007


def test_bad_tables():
    for names, size in ((["a"], 8), ([], 7), (["a", "a"], 7), (list("abcd"), 3)):
        with pytest.raises(ValueError):
            sh.fill_table(names, size)


def test_rows(spark):
    rows = [(1, "x", "old"), (1, "x", "old"), (None, None, None), (2, "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sh.assign_shards(df, ["a", "b", "c"], F.col("doc_id"), 11).collect()
    table = sh.fill_table(["a", "b", "c"], 11)
    assert len(got) == 4
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 11
        assert (r.slot, r.shard) == (slot, "abc"[table[slot]])
    assert sh.assign_shards(df.limit(0), ["a"], F.col("doc_id"), 11).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    sh.write_shards(df, str(tmp_path / "out"), ["a", "b", "c"], F.col("doc_id"), files=2, size=101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(500))
    assert {r.shard for r in back.collect()} == {"a", "b", "c"}


def test_columns_of_inner_names(spark):
    names = ["_at", "_slot", "_shard", "at", "table_slot", "table_shard", "k"]
    df = spark.createDataFrame([(1, *range(7)), (None, *range(7))], f"doc_id long, {', '.join(f'{c} int' for c in names)}")
    out = sh.assign_shards(df, ["a", "b"], F.col("doc_id"), 7)
    assert out.columns == [*df.columns, "slot", "shard"]
    assert sorted(map(tuple, out.select(df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
