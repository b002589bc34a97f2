"""Every registered query of the library against its SQL; those without SQL must give rows."""

from __future__ import annotations

import pytest

from pitsports.plans import registry
from tests.conftest import SF
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    check(spark, con, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_library_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"pitsports\.llm|from \.+llm", path.read_text()), path
