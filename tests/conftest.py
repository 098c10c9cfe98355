import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from transmuta import local_session

    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """files(repo, path, content) from {path: content}."""
    def make(tree, repo="p"):
        return spark.createDataFrame([(repo, f"{repo}/{p}", c) for p, c in tree.items()], "repo string, path string, content string")
    return make
