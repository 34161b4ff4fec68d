import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sentivane.session import builder, small_table  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = (
        builder("tests").master("local[2]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", folder)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    plain = session.createDataFrame

    def create(data, schema=None, **kw):
        if isinstance(data, list) and isinstance(schema, str):
            session.createDataFrame = plain
            try:
                return small_table(session, data, schema)
            finally:
                session.createDataFrame = create
        return plain(data, schema, **kw)

    session.createDataFrame = create  # literal rows without Python workers
    yield session
    session.stop()
