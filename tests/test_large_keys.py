"""Queries against their SQL on tables whose keys have more digits than a printed code has places."""

import duckdb
import pytest

from huemill.plans import registry

from tests.test_queries import SF, TABLES, plain

WIDE = {
    "part": "SELECT * FROM part UNION ALL SELECT * REPLACE (p_partkey + 1000000 AS p_partkey) FROM part",
    "orders": "SELECT * FROM orders UNION ALL SELECT * REPLACE (o_orderkey + 1000000 AS o_orderkey) FROM orders",
    "lineitem": "SELECT * FROM lineitem UNION ALL SELECT * REPLACE (l_orderkey + 1000000 AS l_orderkey, l_partkey + 1000000 AS l_partkey) FROM lineitem",
}
NAMES = [
    "color_pages",
    "codes_by_group",
    "code_search",
    "price_seed",
    "price_layers",
    "token_classify",
    "home_counts",
    "home_codes",
]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for t in TABLES:
        c.execute(f"COPY ({WIDE.get(t, f'SELECT * FROM {t}')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_query_on_long_keys(spark, wide, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{wide}/{t}.parquet'")
    df = registry.queries()[name](spark, str(wide))
    cols = sorted(df.columns)
    rows = c.sql(registry.oracle_sql()[name])
    at = [rows.columns.index(x) for x in cols]
    assert sorted(tuple(plain(r[x]) for x in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rows.fetchall())
