import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import get_session

    return get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.sql.maxMetadataStringLength": "2000", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})


@pytest.fixture
def tmp(tmp_path):
    return f"file://{tmp_path}"
