import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_and_columns(spark):
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and {"p2_found", "p4_found"} <= names


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", ["p2_found", "p4_report", "attr_all", "search_outfit", "eval_verdicts"])
def test_against_sql(spark, name):
    import compare

    assert compare.main(SMALL, [name]) == 0
