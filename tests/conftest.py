import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqdrift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, memory="4g")


@pytest.fixture(scope="session")
def small_chunks(spark):
    """Makes every key longer than a few rows count as hot."""
    class Chunks:
        def __enter__(self):
            spark.conf.set("seqdrift.chunkRows", "4")

        def __exit__(self, *_):
            spark.conf.unset("seqdrift.chunkRows")

    return Chunks()
