import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparkcohort.session import local_session

    session = local_session("tests", cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", "64")
    yield session
    session.stop()


def data(sf: str) -> str:
    return f"/root/testdata/{sf}"
