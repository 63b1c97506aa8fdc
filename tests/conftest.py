import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from panelsmith.session import local_session, release_scratch

    s = local_session(8, 4, "tests")
    yield s
    release_scratch(s)
    s.stop()
