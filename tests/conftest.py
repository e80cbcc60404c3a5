import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafmill.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "tests", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of four pages, so that small fixtures cross block borders."""
    from leafmill.operators import select
    from leafmill.plans import scale

    monkeypatch.setattr(scale, "BLOCK_BITS", 2)
    monkeypatch.setattr(scale, "PAGES_PER_BLOCK", 4)
    monkeypatch.setattr(select, "PAGES_PER_BLOCK", 4)
    monkeypatch.setattr(select, "FINE", 3)


@pytest.fixture
def eager_salting(monkeypatch):
    """Treat every repeated key as heavy."""
    from leafmill.plans import scale

    monkeypatch.setattr(scale, "SLICE_ROWS", 2)


@pytest.fixture
def many_partitions(spark):
    """Keep small shuffles in as many partitions as a large one would have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
