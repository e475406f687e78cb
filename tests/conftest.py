import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from sluice.session import get_session

    session = get_session("tests", cores=4, **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "4g"})
    yield session
    session.stop()
