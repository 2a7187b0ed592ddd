import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cellreach.session import local_session

    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, 4, **{"spark.checkpoint.dir": folder, "spark.driver.memory": "4g", "spark.sql.warehouse.dir": folder + "/warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
