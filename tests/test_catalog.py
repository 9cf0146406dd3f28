"""Registered queries against their SQL. All of them with QUADLAB_ALL=1, else one per area."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
SOME = ["fn_02_is_negative", "geo_07_valid_area", "geo_17_quad_issues", "cmp_02_polygon_iou_ccw", "arr_06_decode_heat_centroid",
        "src_04_read_predictions", "snk_01_write_split", "jn_12_effective_labels", "ag_01_detection_metrics", "wn_01_drop_min_until_mean",
        "sm_02_sample_negatives", "job_01_consensus_vote", "job_05_teacher_removals", "job_07_gt_outliers", "job_14_clean_splits_by_target",
        "job_26_apply_review_state", "udf_01_score", "str_01_running_metrics", "str_02_running_worst", "str_03_running_review_state"]
NAMES = list(entry.queries()) if os.environ.get("QUADLAB_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    text, ok = compare(spark, con, name, SF)
    assert ok, text


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
