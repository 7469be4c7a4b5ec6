from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from automill.model import build  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"

#: An automaton with several components, shapes and sets, for transforms and statistics.
MIXED = build(
    "mixed",
    [
        {"id": "a0", "symbols": "[a-f]", "start": "all-input"}, {"id": "a1", "symbols": "[^a]"}, {"id": "a2", "symbols": "[ace]", "code": "A"},
        {"id": "b0", "symbols": "*", "start": "start-of-data"}, {"id": "b1", "symbols": "\\w", "code": "B"},
        {"id": "c0", "symbols": "[xyz]", "start": "all-input"}, {"id": "c1", "symbols": "[^\\n\\r]"}, {"id": "c2", "symbols": "[0-9a]"},
        {"id": "c3", "symbols": "[q]"}, {"id": "c4", "symbols": "[r]"}, {"id": "c5", "symbols": "[s]"}, {"id": "c6", "symbols": "[t]", "code": "C"},
    ],
    [
        ("a0", "a1"), ("a1", "a2"), ("b0", "b0"), ("b0", "b1"), ("c0", "c1"), ("c1", "c1"), ("c1", "c2"), ("c1", "c3"), ("c1", "c4"), ("c1", "c5"),
        ("c2", "c6"), ("c3", "c6"), ("c4", "c6"), ("c5", "c6"), ("c6", "c1"),
    ],
)
