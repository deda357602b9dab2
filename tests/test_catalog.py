"""Every query of the library against its SQL, and the entry module with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import same_rows

from sparkloom.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", catalog.SQL)
def test_sql(spark, name):
    assert same_rows(spark, catalog.QUERIES[name], catalog.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["kind", "id", "line", "value"]
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sparkloom"), tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and len(e.oracle_sql()) > 40 and not any(k == 'pipeline' or k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
