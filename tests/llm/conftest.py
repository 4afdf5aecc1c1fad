import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest  # noqa: E402

@pytest.fixture(autouse=True)
def ready(request):
    if "spark" in request.fixturenames:
        from fleetrisk.llm.common import prepare

        prepare(request.getfixturevalue("spark"))
