import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tradeweave.session import local_session, remove_written

    session = local_session("8", "tests", memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    # Hand-made graphs are tiny: plan them statically, in few tasks.
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    yield session
    remove_written(session)
    session.stop()
