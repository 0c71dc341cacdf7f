import os
import shutil
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from symloom.session import build_session

    session = build_session("local[4]", 4, "4g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    made = session.conf.get("spark.checkpoint.dir", None)
    session.stop()
    if made and "symloom-" in made:
        shutil.rmtree(made.removeprefix("file://"), ignore_errors=True)


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
