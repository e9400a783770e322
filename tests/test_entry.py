import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_belong_together():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and all(map(callable, e.queries().values()))


def test_core_stands_alone():
    """Without the subpackage for training data the rest imports, and offers its own queries."""
    code = "import sys; sys.modules['lexiquarry.llm'] = None; import __spark_entry__ as e; import lexiquarry.engine, lexiquarry.streaming.segments; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    found = e.entry(spark)
    assert found.columns == ["rank", "doc_id", "file_name", "score"] and found.count() > 0
