"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gaugeline import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# Queries without SQL: loops too long for it, tested against brute force.
ROWS_ONLY = {"cf_compact", "gmm_fit"}
CHECKED = [
    "record_outliers", "record_outliers_in_arrays", "upload_parse", "batch_upload_report", "record_write",
    "record_page", "quality_grade", "detection_trend", "overview", "device_latest", "shadow_sync",
    "cf_leaves", "cf_geometry", "cf_from_json", "cf_delta", "nearest_leaf_cf", "cf_online_outlier",
    "rolling_history_z", "dbscan_1d", "single_link_1d", "silhouette", "knn_distance", "adaptive_eps",
    "lloyd_step", "stream_cf_leaves", "stream_dedup", "drift_scan",
]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(map(str, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    ours = rows(catalog.QUERIES[name](spark, str(DATA)).toPandas())
    assert ours == rows(db.execute(catalog.SQL[name]).df())


def test_every_sql_text_runs(db):
    for name, sql in catalog.SQL.items():
        db.execute(f"EXPLAIN {sql}")


def test_registry():
    assert set(catalog.QUERIES) - set(catalog.SQL) == ROWS_ONLY
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert set(entry.queries()) >= set(catalog.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
