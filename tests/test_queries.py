import pytest
from oracle import same

from strandmill.plans import files, problems, reference

WITH_SQL = [(m, n) for m in (problems, reference, files) for n in m.ORACLES]
WITHOUT = [(m, n) for m in (problems, reference, files) for n in m.QUERIES if n not in m.ORACLES]


@pytest.mark.parametrize("module,name", WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_equals_sql(spark, data, module, name):
    same(module.QUERIES[name](spark, data), data, module.ORACLES[name])


@pytest.mark.parametrize("module,name", WITHOUT, ids=[n for _, n in WITHOUT])
def test_runs_twice_alike(spark, data, module, name):
    a, b = (sorted(map(str, module.QUERIES[name](spark, data).collect())) for _ in range(2))
    assert a == b and a


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "p1_found" in e.queries()
