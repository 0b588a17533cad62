"""Registered queries against their SQL on the smallest tables (all of them: tests/oracle.py)."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = ["assess_register", "assess_unknown_matches", "assess_insider", "candidate_lists",
        "rounding_groups", "generalise_columns", "tradeoff_steps", "class_neighbours",
        "column_profile", "link_by_address", "latest_label", "shift_of_columns",
        "category_comparison", "number_comparison", "hex_cells", "cell_statistics",
        "inside_polygons", "exposed_walls", "neighbours_and_blocks", "signature_mwa",
        "signature_as_learned", "sun_on_walls"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registry_is_complete():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(sqls) <= set(queries) and set(SOME) <= set(sqls)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, con, name):
    verdict, _, info = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict == "ok", info


def test_entry(spark):
    assert entry.entry(spark).count() > 0
