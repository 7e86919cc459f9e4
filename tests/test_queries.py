"""Every query of the library against its SQL, and that it names the same columns at any size."""

import pytest
from compare import compare
from dealgrain.plans import catalogue


#: held against loops in test_brute_force.py
LOOPS = {"aligned_chains", "chain_order", "hunk_attribution", "move_greedy_match", "pairwise_line_distance", "reversals", "taxonomy_induction", "word_hunks"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLES:
        assert compare(df, catalogue.ORACLES[name], sf) == ""
    else:
        assert name in LOOPS and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
