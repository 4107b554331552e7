import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from check import rows_of
from contract.views import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["e1_suggest", "e3_geocode_address", "e4_geocode_crossing", "q6_combined", "s7_street_docs", "x6_x10_query_chain"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    cur = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", ["e3_geocode_address", "e5_j7_batch"])
def test_requests_are_made_once(spark, tmp_path, name):
    rows = {
        "part": spark.createDataFrame([(1, "red bolt", 7), (2, "new rod", 50)], "p_partkey long, p_name string, p_size int"),
        "lineitem": spark.createDataFrame([(5, 1), (5, 2), (6, 2)], "l_orderkey long, l_partkey long"),
        "orders": spark.createDataFrame([(5, 3, "F", "2-HIGH"), (6, 8, "O", "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
    }
    for table, df in rows.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    done = contract.queries()[name](spark, str(tmp_path))
    assert {r["req_id"] for r in done.collect()} == {5, 6}
    assert not [f for f in done.inputFiles() if f"{tmp_path}/" in f]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_contract_imports_without_the_jars(tmp_path):
    code = (
        "import pyspark, pathlib\n"
        f"pyspark.__file__ = {str(tmp_path / '__init__.py')!r}\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "assert SparkSession.getActiveSession() is None\n"
        "assert len(e.oracle_sql()) >= 70 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
