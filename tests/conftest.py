import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from longfeat.session import local_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_root():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def mid_root():
    return f"{DATA}/sf0.01"


@pytest.fixture
def rows(spark):
    """Build a DataFrame from rows and a DDL schema; dates may be text."""

    def make(data, ddl):
        names = [c.strip().rsplit(" ", 1) for c in ddl.split(",")]
        loose = ", ".join(f"{n} {'string' if t == 'date' else t}" for n, t in names)
        df = spark.createDataFrame(data, loose)
        return df.selectExpr(*[f"cast({n} as {t}) as {n}" for n, t in names])

    return make


def as_set(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(str(x) if x is not None else None for x in r) for r in df.collect()), key=str)


@pytest.fixture
def table():
    return as_set
