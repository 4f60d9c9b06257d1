import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sendero.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session(app="sendero-tests", master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="sendero-test-")


def inter_rows(spark, rows, columns=None):
    """Interaction fixture rows with the declared columns (missing -> null)."""
    from sendero.operators.clean import clean_interactions
    from sendero.sources.schemas import INTERACTION_COLUMNS

    cols = columns or INTERACTION_COLUMNS
    data = [tuple(r.get(c) for c in cols) for r in rows]
    schema = ", ".join(f"`{c}` string" for c in cols)
    return clean_interactions(spark.createDataFrame(data, schema))
