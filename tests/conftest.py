import os
from pathlib import Path

import pytest

from corpusmill.session import local_session


os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])


# Made at import, so that test modules can build columns.
SESSION = local_session(cores=4, shuffle_partitions=4, memory="3g")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION
