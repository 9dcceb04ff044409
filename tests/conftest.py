import logging
import os
import sys

import pytest

logging.disable(logging.CRITICAL)
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from scorelake.session import local_session

    session = local_session(8, "8g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
