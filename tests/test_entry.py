"""The driver contract of __spark_entry__.py."""

import importlib.util
import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_contract(spark):
    se = _entry_module()
    df = se.entry(spark)
    assert df.columns == ["page_id", "s", "c", "f", "e", "all", "m", "u", "x", "page_status"]
    assert df.count() == 50
    q, sql = se.queries(), se.oracle_sql()
    assert set(sql) <= set(q)
    own = {n for n in q if n != "pipeline" and not re.match(r"op\d+_", n)}  # the others are optional
    # no closed form in SQL; tests/test_similarity.py holds it against the standard library
    assert own - {"match_whole"} <= set(sql)
    for name, text in sql.items():
        assert "SELECT" in text.upper(), name
