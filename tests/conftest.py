import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webloom.session import ensure_checkpoint_dir, local_session  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    wh = tempfile.mkdtemp(prefix="webloom-wh-", dir="/tmp")
    s = local_session(cores="*", shuffle_partitions=8, extra={"spark.sql.warehouse.dir": wh})
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def mini_graph(spark):
    """Hand-worked graph M (see FIXTURES.md)."""
    from webloom.operators.graph import link_pages_graph
    rows = [("A", ["B", "B", "C", "C", "X"]), ("B", ["C"]), ("C", ["A", "C"]), ("D", ["A"]),
            ("E", [])]
    df = spark.createDataFrame(rows, "url string, links array<string>")
    return link_pages_graph(df)
