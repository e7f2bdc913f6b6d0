import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from srcindex.session import checkpoint_root, get_session
    s = get_session("local[4]", shuffle_partitions=8, app_name="srcindex-tests")
    checkpoint_root(s)  # sets a private folder only when the session has none
    yield s


@pytest.fixture()
def tmpdir_local(tmp_path):
    return str(tmp_path)
