import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusweave.session import build

    folder = tmp_path_factory.mktemp("shared")
    session = build("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=str(folder), spark__sql__warehouse__dir=str(folder / "warehouse"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
