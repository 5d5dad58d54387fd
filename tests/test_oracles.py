"""Every registered query of the retrieval engine against its SQL on the smallest tables."""

import pytest

from tests.conftest import SMALL
from tessera import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(name, spark, same):
    same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark, duck):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry_without_the_llm_folders(spark, duck, monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__, "find_spec", lambda n: None if "llm" in n or n == "corpus_pipeline" else real(n))
    assert not any(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) == set(catalog.ORACLES)
    assert __spark_entry__.entry(spark).count() > 0
