import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tools.check_oracles import TABLES, compare

ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def tables(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    return connection


def test_every_statement_has_its_query():
    assert set(ORACLES) <= set(spark_entry.queries())


def test_entry_without_a_library_that_the_operators_need():
    code = (
        "import sys, re, warnings; sys.modules['ahocorasick'] = None; warnings.simplefilter('ignore');"
        "import __spark_entry__ as e; names = [*e.queries(), *e.oracle_sql()];"
        "assert 'triage_batch' in names and not any(re.match(r'op\\d+_|pipeline', n) for n in names)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(spark_entry.__file__).parent, check=True)


def test_flagship_runs(spark):
    assert spark_entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, tables, name):
    got = spark_entry.queries()[name](spark, small).toPandas()
    assert compare(got, tables.execute(ORACLES[name]).df()).startswith("ok")
