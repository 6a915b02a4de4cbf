import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def folder(spark):
    from loopstats.llm.common import scratch

    return scratch(spark)
