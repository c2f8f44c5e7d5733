"""Every query of the subpackage against its SQL; the guard of the entry module."""

import pytest
from llm_tables import FOLDER
from oracle import difference, duck

import __spark_entry__ as contract
from stayspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(duck(FOLDER), ORACLES[name], QUERIES[name](spark, FOLDER)) is None


def test_queries_are_registered():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
