"""Every registered query against its SQL; those without SQL run and keep their shape."""

import os
import subprocess
import sys

import oracle
import pytest

import __spark_entry__ as contract
from opinio.plans.catalog import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECKED = sorted(contract.oracle_sql())
#: Model fits and the like, which SQL cannot express.
UNCHECKED = sorted(set(QUERIES) - set(contract.oracle_sql()))


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, sf, con, name):
    assert oracle.compare(contract.queries()[name](spark, sf), con, contract.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs_without_sql(spark, sf, name):
    df = contract.queries()[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_plans_import_without_the_installation(tmp_path):
    """Nothing beside the package is read while the plans are imported."""
    code = (
        "import builtins, glob, sys, zipfile\n"
        "def refuse(*a, **k): raise AssertionError(a)\n"
        "import pyspark.sql, pyspark.ml.feature, pyspark.ml.clustering\n"
        "glob.glob = zipfile.ZipFile = refuse\n"
        f"sys.path.insert(0, {ROOT!r})\n"
        "import opinio.plans.catalog as c\n"
        "assert len(c.QUERIES) > 150\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["version", "n", "avg_rating", "positive", "neutral", "negative", "response_rate"]
    assert 0 < df.count() <= 10


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
