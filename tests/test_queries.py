"""Every registered query of the reference operators: against DuckDB where there is SQL, else rows and schema."""

from __future__ import annotations

import pytest

from rostrum.plans import casing_queries, detail_queries, filter_queries, join_queries, label_queries, markup_queries, people_queries, registry, source_queries, state_queries, sweep_queries, table_queries, text_queries, title_queries  # noqa: F401

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.oracle_sql()])
def test_query_equals_sql(name, spark, folder, agree):
    agree(registry.queries()[name](spark, folder), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in registry.oracle_sql()])
def test_query_runs(name, spark, folder):
    df = registry.queries()[name](spark, folder)
    assert df.columns
    df.collect()


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
