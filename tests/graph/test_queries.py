import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import spark_rows, sql_rows

from shapeloom.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, name):
    assert spark_rows(queries()[name](spark, SF)) == sql_rows(SF, oracle_sql()[name])
