"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import os
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, database
from shelfgrain.plans.registry import QUERIES

NAMES = sorted(set(queries()) & set(QUERIES))


@pytest.fixture(scope="module")
def connection(folder):
    return database(folder)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries()) & set(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, folder, name):
    problem, _, _ = compare(spark, connection, folder, name, queries()[name], oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    made = entry(spark)
    assert {"page_id", "source_url", "name", "price_kes"} <= set(made.columns)
    assert made.count() > 0


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["site_catalog", "lean_catalog", "product_lookup", "coverage_rate", "health_signal"])
def test_no_pairwise_joins(spark, folder, name):
    text = plan(queries()[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_name_query_reads_and_shuffles_only_what_it_needs(spark, folder):
    text = plan(queries()["dedup_by_name"](spark, folder))
    assert "IsNotNull(html)" in text
    assert text.index("Exchange hashpartitioning(name") < text.index("partial_min_by") < text.index("MapInArrow")


def test_links_need_no_shuffle_after_the_parse(spark, folder):
    text = plan(queries()["page_links_capped"](spark, folder))
    assert "Exchange" not in text[:text.index("MapInArrow")]
    assert "Window" not in text


def test_runs_from_any_folder(tmp_path):
    """Workers find the package although neither they nor the driver start in its folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "elsewhere.py"
    script.write_text(f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {os.path.join(root, '__spark_entry__.py')!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", module.entry(spark).count())
""")
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=environment, capture_output=True,
                          text=True, timeout=300)
    assert done.returncode == 0 and "rows " in done.stdout, done.stderr[-2000:]
