import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import spark_rows, sql_rows

from shapeloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == sql_rows(SF, queries.oracle_sql()[name])
