"""Registered queries take all rows of their inputs; plain Python repeats them on the smallest tables."""

import os

import pytest

from provspark.plans import catalogue
from provspark.plans.fixtures import view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def column(spark, name):
    return {r["fn_start"] for r in catalogue.QUERIES[name](spark, SF).collect()}


def test_seeds_and_barrier_are_all_hits(spark):
    def fx(name):
        return view(spark, SF, name)

    certain, barrier = ({r["fn_start"] for r in x.collect()} for x in catalogue.seeds_and_barrier(fx))
    assert certain == column(spark, "certain_set")
    assert barrier == column(spark, "dep_boundary")


def test_attribution_plain(spark):
    functions = {r["fn_start"] for r in view(spark, SF, "fx_functions").collect()}
    calls = {(r["caller"], r["callee"]) for r in view(spark, SF, "fx_calls").collect()}
    seeds, barrier = column(spark, "certain_set") & functions, column(spark, "dep_boundary")

    def walk(edges):
        seen, front = set(seeds), set(seeds)
        while front:
            front = {b for a, b in edges if a in front and b in functions and b not in barrier} - seen
            seen |= front
        return seen

    reached = walk(calls)
    disputed = {b for a, b in calls if a not in reached}
    want = {f: "certain" if f in seeds else "library" if f not in reached else "indeterminate" if f in disputed else "inferred" for f in functions}
    assert {r["fn_start"]: r["attribution"] for r in catalogue.QUERIES["attribution_unbounded"](spark, SF).collect()} == want
    assert column(spark, "backtrace_inf") == walk({(b, a) for a, b in calls}) - seeds


def test_views_take_all_rows(spark):
    def rows(table):
        return spark.read.parquet(f"{SF}/{table}.parquet")

    part, customer = rows("part").count(), rows("customer").count()
    assert catalogue.QUERIES["ident_case_class"](spark, SF).count() == part
    assert view(spark, SF, "fx_strings").select("vaddr").distinct().count() == customer
    pairs = {(4096 + r["l_partkey"] * 256, 4096 + (r["l_suppkey"] * 20 + r["l_linenumber"] * 3 + r["l_orderkey"]) % part * 256) for r in rows("lineitem").collect()}
    assert {(r["caller"], r["callee"]) for r in view(spark, SF, "fx_calls").collect()} == pairs
