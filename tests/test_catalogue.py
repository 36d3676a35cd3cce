"""Every query has SQL; a spread of them is run against DuckDB."""

import os

import pytest

from provspark.plans import catalogue, images

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "origin_classify root_autodetect location_hits tier_functions json_contract function_asof function_interval attribution_depth1 backtrace_d2 precision_rollup leading_crate_v4 disputed_class rule_tradeoff ident_sweep lea_mov_pairs bench_summary depth_sweep backtrace_sweep image_symbols image_fallback image_call_edges image_debug_entries image_bare_anchors tier_symbols symbol_ladder bare_anchor_precision bare_anchor_precision_symbols install_checks fp_category fp_kind subcat collect_summary".split()


def test_names():
    assert len(catalogue.QUERIES) >= 85
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_image_queries_have_sql():
    assert set(images.QUERIES) == set(images.ORACLES) and not set(images.QUERIES) & set(catalogue.QUERIES)


def test_registry():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute((catalogue.ORACLES | images.ORACLES)[name])
    columns = [d[0] for d in want.description]
    got = (catalogue.QUERIES | images.QUERIES)[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
