from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from weft.session import session

    os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")
    folder = tempfile.mkdtemp(prefix="weft-tests-")
    s = session(
        "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=f"{folder}/warehouse", spark__checkpoint__dir=f"{folder}/checkpoints",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
