"""Queries over reports against their SQL, with keys of as many digits as large tables have."""

import os

import duckdb
import pytest
from test_queries import plain

from casegraph import plans


@pytest.fixture(scope="module")
def wide(sf_dir, tmp_path_factory):
    """The smallest tables, with customer keys of five to eight digits."""
    d = tmp_path_factory.mktemp("wide")
    for file in os.listdir(sf_dir):
        if file != "customer.parquet":
            os.symlink(f"{sf_dir}/{file}", d / file)
    duckdb.connect().sql(f"COPY (SELECT * REPLACE (c_custkey + CAST(99950 * pow(10, c_custkey % 3) AS BIGINT) AS c_custkey) FROM '{sf_dir}/customer.parquet') TO '{d}/customer.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["e14_mentioned_in", "m4_m8_mentions", "m9_mention_counts", "e0_e18_ingest", "e18_u8_second_batch"])
def test_query_equals_its_sql_where_keys_are_long(spark, wide, name):
    con = duckdb.connect()
    for file in os.listdir(wide):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{wide}/{file}'")
    want = con.execute(plans.oracles()[name])
    columns = [c[0] for c in want.description]
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    expected = rows(want.fetchall())
    assert rows(plans.queries()[name](spark, wide).select(*columns).collect()) == expected and expected
