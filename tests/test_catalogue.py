"""Every query against its SQL."""

import pytest

from glyphmill.plans import catalogue
from tests.conftest import DATA, rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert name in catalogue.ORACLES
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_optional_part():
    from pathlib import Path

    root = Path(catalogue.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "glyphmill.llm" in p.read_text()]
