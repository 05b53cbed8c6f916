import os
import subprocess
import sys

import pytest

import __spark_entry__ as driver
from sitemill import workspace

SMALL = "/root/testdata/sf0.001"


LOAD = """
import glob, pathlib, zipfile
def refuse(*args, **kwargs):
    raise OSError("no jars here")
zipfile.ZipFile = glob.glob = refuse
import pyspark
pyspark.__file__ = "/nowhere/pyspark/__init__.py"
from checks import catalogue
found, texts = catalogue.queries(), catalogue.oracle_sql()
assert set(found) == set(texts) and len(found) >= 65, (len(found), len(texts))
"""


def test_queries_and_sql_load_without_session_and_jars():
    run = subprocess.run([sys.executable, "-c", LOAD], cwd=os.path.dirname(driver.__file__), capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_queries_load_without_the_optional_subpackage():
    code = "import sys; sys.modules['sitemill.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) >= 65"
    run = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(driver.__file__), capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
def test_entry(spark):
    found = driver.entry(spark)
    assert "paradigm_keywords" not in found.columns and {"mainURL", "yake_tags", "kind"} <= set(found.columns)
    assert found.count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
@pytest.mark.parametrize(
    "name", ["contact_report", "route_links", "rank_site_links", "site_text", "vocab_join", "yake_terms", "entity_tags"]
)
def test_plans_have_no_cross_products(spark, name):
    plan = driver.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
def test_scans_read_only_what_they_need(spark):
    plan = driver.queries()["url_split"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_staging_uses_the_session_folder(spark):
    root = workspace.staging_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    assert workspace.ensure_local_root(spark) is None and workspace.staging_root(spark) == root
    staged = workspace.stage(spark.range(3), "t")
    assert staged.count() == 3 and root in staged.inputFiles()[0]
