import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def llm_spark(spark):
    from pactline.llm.common import ship

    return ship(spark)
