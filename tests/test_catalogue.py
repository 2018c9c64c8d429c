"""Every registered query of the engine against its SQL."""

import duckdb
import pytest
from helpers import same_rows

from rivulet.plans.catalogue import ORACLE_SQL, QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["fold_math", "scalar_math"])
def test_part_keys_whose_squares_are_beyond_integer(spark, sf, tmp_path, name):
    con = duckdb.connect()
    keys = [0, 47040, 47041, 1_199_999, 2**31 - 1, 701 - 2**31]
    con.execute(f"COPY (SELECT p.* REPLACE (CAST(k AS BIGINT) AS p_partkey) FROM (FROM '{sf}/part.parquet' ORDER BY p_partkey LIMIT 1) p, (SELECT unnest({keys}) AS k)) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet'")
    same_rows(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name])
