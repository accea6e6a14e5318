import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from adlens.session import local_session, shared_dir

    s = local_session(4, 4, app="adlens-tests")
    shared_dir(s)  # uses spark.checkpoint.dir, or a fresh local folder when unset
    yield s
    s.stop()


@pytest.fixture()
def workdir(tmp_path):
    return str(tmp_path)
