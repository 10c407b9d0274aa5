import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from helpers import sf_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from mailmetrics.session import local_session

    s = local_session(4, shuffle_partitions=4, app="mailmetrics-tests")
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from mailmetrics.oracle.compare import duckdb_connection

    return duckdb_connection(sf_dir("0.001"))


@pytest.fixture(scope="session")
def duck_mid():
    from mailmetrics.oracle.compare import duckdb_connection

    return duckdb_connection(sf_dir("0.01"))
