"""Row layouts and default parameters."""

from __future__ import annotations

# Field names and types of the messages on the wire.
DATA_ITEM = "struct<type:int,vals:array<double>,outlier_indices:array<int>>"

UPLOAD = (
    "id string, dev_code string, img1_w int, img1_h int, img2_w int, img2_h int, img3_w int, "
    "img3_h int, factor double, high double, par1 string, par2 string, par3 string, url1 string, "
    f"url2 string, url3 string, record_time string, data_list array<{DATA_ITEM}>, source int"
)

CENTROID = (
    "struct<n:bigint,centroid:array<double>,radius:double,diameter:double,"
    "ls:array<double>,ss:array<double>>"
)

SNAPSHOT = (
    "version string, tree_id string, gateway_code string, measure_point_id string, "
    "data_type string, timestamp string, "
    "config struct<radius_threshold:double,max_children:int>, "
    "stats struct<total_points_processed:bigint,total_points:bigint,total_clusters:bigint,"
    "outlier_count:bigint>, "
    f"centroids array<{CENTROID}>, serialization_method string"
)

TELEMETRY = (
    "device_code string, timestamp string, "
    "cpu struct<usage_percent:float,temperature_celsius:float>, "
    "gpu struct<usage_percent:float,temperature_celsius:float,memory_used_mb:int,"
    "memory_total_mb:int>, "
    "memory struct<used_mb:bigint,total_mb:bigint>, "
    "network struct<rx_mbps:float,tx_mbps:float>, "
    "inference struct<last_inference_ms:float,total_inferences:bigint,avg_inference_ms:float>, "
    "clustering struct<cf_tree_size:int,last_cluster_ms:float,total_points_processed:bigint,"
    "total_outliers_detected:bigint>"
)

# Defaults of the measurement platform.
RADIUS_THRESHOLD = 1.0
MAX_CHILDREN = 5
SIGMA_FACTOR = 3.0
CONSECUTIVE_LIMIT = 3
MIN_DETECT_POINTS = 10
MIN_BASELINE_POINTS = 2
RADIUS_FLOOR = 0.01
SIGMA_FLOOR = 0.1
RECORD_MIN_VALUES = 5
RECORD_MIN_SIGMA = 0.01
RECORD_Z = 2.5
HISTORY_WINDOW = 100
HISTORY_MIN = 10
PAGE_SIZE = 20
KMEANS_K = 3
KMEANS_ROUNDS = 100
MERGE_K = 3
MERGE_ROUNDS = 50
DBSCAN_EPS = 0.5
DBSCAN_MIN_POINTS = 5
KNN = 5
BOOTSTRAPS = 10
BOOTSTRAP_RATIO = 0.8
ONLINE_MINUTES = 5
READING_RETENTION = "1 year"
DEVICE_CODE = r"^[A-Z]{2}-\d{8}$"
SNAPSHOT_VERSION = "1.0"
SNAPSHOT_METHOD = "birch_cf_v1"
DEVICE_TYPES = {"GW": "网关", "ED": "边缘设备", "SN": "传感节点", "CM": "摄像头"}
OUTLIER_HINT = "测点%s 存在%d个离群值"
