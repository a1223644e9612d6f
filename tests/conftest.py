from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugeline.plans.groups import LIMIT_SETTING  # noqa: E402
from gaugeline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=[None, 9], ids=["whole", "split"])
def any_split(request, spark):
    """Runs a test with plain windows and with every key above 9 rows split."""
    if request.param:
        spark.conf.set(LIMIT_SETTING, str(request.param))
    yield request.param
    spark.conf.unset(LIMIT_SETTING)
