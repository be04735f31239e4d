"""Every style query against its SQL at the smallest scale, and the entry point without the optional part."""

import duckdb
import pytest

from scriptorium.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["style_distance", "rules_check", "segment_counts", "avoided_spans"])
def test_with_generated_code(spark, duck, name):
    """As production runs it; the other tests do without whole-stage code, which takes longer to compile than to run here."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        test_against_sql(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
