import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)



@pytest.fixture(scope="session")
def spark():
    from prepark.session import local_session

    s = local_session("*", shuffle_partitions=8, app="prepark-tests")
    yield s


@pytest.fixture()
def tmpdir_path(tmp_path):
    return str(tmp_path)
