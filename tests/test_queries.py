"""Every query against its DuckDB twin; the others run and keep their shape."""

import oracle
import pytest

from tsloom.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf_dir, name):
    assert oracle.compare(spark, QUERIES[name], SQL[name], sf_dir) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and all(v is not None for v in rows[0])
