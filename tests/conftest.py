import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from phasewise.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, memory="8g")
