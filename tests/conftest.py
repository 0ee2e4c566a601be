from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
#: Stand-ins for libraries and programs that aren't installed here; workers find them, this process only where a test says so.
STANDINS = ROOT / "tests" / "standins"
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}:{STANDINS}"
os.environ["PATH"] = f"{os.environ['PATH']}:{STANDINS / 'bin'}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the generated tables aren't here")
    return path
