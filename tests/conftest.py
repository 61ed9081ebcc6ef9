import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from framewright.session import local_session  # noqa: E402


# columns are built while the test modules load, which needs a session
SESSION = local_session(4, "tests")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = SESSION
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


@pytest.fixture
def values(spark):
    """Evaluate a builder over literal rows: values(rows, schema, column...)."""

    def run(rows, schema, *cols):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]

    return run
