"""Work that must not grow with the number of pages, on tables that are wide for their size."""

import os

import pytest
from pyspark.sql import functions as F

from huemill.plans import file_queries, registry

SF = "/root/testdata/sf0.001"


def test_product_indexes_are_few_files(spark, tmp_path, monkeypatch):
    """500 pages, not 500 files; each page's rows keep their order and number."""
    item = spark.range(2000).select(
        F.col("id").alias("l_orderkey"), (2000 - F.col("id")).alias("l_partkey"), (F.col("id") % 500).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"),
        F.when(F.col("id") < 500, "A").otherwise("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
    )
    monkeypatch.setattr(file_queries, "table", lambda *_: item)
    monkeypatch.setattr(file_queries, "shared_folder", lambda _: str(tmp_path / "index"))
    got = {r.key: (r.first, r.words, r.n) for r in file_queries.product_rows(spark, "").collect()}
    assert got == {str(k): (str(500 - k), "A+Ox+R", 4) for k in range(500)}
    assert len([p for p in (tmp_path / "index").rglob("*") if p.name.startswith("part-")]) <= 32


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["finish_rejects", "guide_description", "extract_finishes", "guide_sections"])
def test_finish_tables_read_blocks_once(spark, name):
    """The branches of a finish table read stored blocks and bounds; none goes back to the line items."""
    files = registry.queries()[name](spark, SF).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]
