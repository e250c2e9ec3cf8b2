"""Every registered query with an SQL text equals DuckDB on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = [
    "scored_patches", "recall", "nearest_alarm", "false_alarms", "dedup", "clusters", "leaderboard", "cap_selection", "boot_recall",
    "settings_grid", "census", "line_runs", "normals", "components8", "sheet_assignment", "segments", "interpolation", "profile_rule",
    "auroc", "distribution", "fisher", "eroded_mask", "adapter_review_cues", "alarm_violations", "geometry_violations", "new_batches",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK if not os.environ.get("ALL_QUERIES") else list(entry.queries()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["detector"]: (r["hits"], r["events"], r["kept"], r["false_alarms"]) for r in rows} == {
        "error": (10, 134, 157, 13), "click": (5, 134, 165, 13), "signup": (2, 134, 79, 3)}
