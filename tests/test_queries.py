"""Every registered query of the engine against its SQL."""

import pytest
from compare import assert_same

from wavemill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert_same(spark, sf, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["D1_D2_filters", "F24_channel_summary", "C5_elimination", "C10_best_size", "M1_logreg", "R5_pca", "T6_permutation_impact", "T7_ablation_impact"])
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
