"""p2, p3 and p5 on empty and on cluttered tables."""

import pytest
from edge_tables import SMALL, cluttered, empty, rows

from loamgraph.plans import problems

TABLES = ["entities", "edges", "event_log", "entity_access"]


@pytest.mark.parametrize("name", list(problems.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    empty(spark, str(tmp_path), TABLES)
    assert problems.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def clutter(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("clutter"))
    cluttered(spark, folder, TABLES)
    return folder


@pytest.mark.parametrize("name", ["p2_found", "p2_sessions", "p3_found", "p5_found", "p5_report"])
def test_clutter_changes_nothing(spark, clutter, name):
    assert rows(problems.QUERIES[name](spark, clutter)) == rows(problems.QUERIES[name](spark, SMALL))
