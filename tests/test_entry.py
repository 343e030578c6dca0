import glob
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_queries_have_known_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_llm():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in glob.glob(f"{here}/sceneloom/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "sceneloom.llm" not in open(f).read(), f


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_core_queries_match_sql(spark):
    import compare
    import __spark_entry__ as e

    names = [n for m in e.MODULES for n in m.SQL]
    assert compare.main(SF, names) == 0
    assert sys.modules["compare"]
