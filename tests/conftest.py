import tempfile

import pytest

from sparkwright.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.sql.warehouse.dir": tempfile.mkdtemp(), "spark.driver.memory": "4g"})
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    return session


@pytest.fixture(scope="session")
def sf():
    return SF
