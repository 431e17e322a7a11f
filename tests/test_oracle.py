"""Every registered query against its comparison SQL at the smallest scale."""

import duckdb  # noqa: F401
import pytest

import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


def pytest_generate_tests(metafunc):
    import __spark_entry__ as entry

    metafunc.parametrize("name", sorted(entry.queries()))


@pytest.fixture(scope="module")
def sqls():
    import __spark_entry__ as entry

    return entry.oracle_sql()


def test_query(spark, con, sqls, name):
    import __spark_entry__ as entry

    fn = entry.queries()[name]
    if name not in sqls:
        assert fn(spark, SF).collect() is not None
        return
    state, *_ = oracle.compare(spark, con, SF, fn, sqls[name])
    assert state == "ok", state
