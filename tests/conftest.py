import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
#: folder of labelled (left, right, gt) CSV triples, one folder each; tests on them are skipped without it
TRIPLES = os.environ.get("TRIPLES_DIR", "")


@pytest.fixture(scope="session")
def spark():
    from fuzzyspark.session import get_session
    s = get_session("local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
