"""Named queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from casegraph import plans

NAMES = [
    "x7_x10_dates_amounts", "s1_csv_scan", "s9_s10_document_ids", "e1_e4_calls", "e11_e13_history", "u2_merge_transfer_edges", "u3_bounded_sources", "a2_handset_swaps",
    "g3_g4_projection", "q4_hops", "m1_m2_identifiers", "e15_e17_prose_links", "l2_verify", "l8_merged_turns", "l11_citations",
    "r1_u1_case_nodes", "r1_spellings", "e18_u8_second_batch", "x14_file_spans", "a4_large_transfers", "q5_paths", "q11_ranking", "q14_report", "l13_conclusions", "g8_exact_chains", "g10_cliques",
]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    got = plans.queries()[name](spark, sf_dir)
    want = con.execute(plans.oracles()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    expected = rows(want.fetchall())
    assert rows(got.select(*columns).collect()) == expected and expected


def test_every_query_but_the_iterative_has_sql():
    assert set(plans.queries()) - set(plans.oracles()) == {"g7_pagerank_settled", "g8_g9_betweenness", "g10_communities", "g14_recompute"}
