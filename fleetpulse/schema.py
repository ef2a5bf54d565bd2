"""Column lists and Spark schemas of the tables this library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of a metric sample.
METRICS = [
    "cpu_pct",
    "mem_pct",
    "disk_read_bps",
    "disk_write_bps",
    "net_up_bps",
    "net_down_bps",
    "swap_pct",
]
IO_METRICS = ["disk_read_bps", "disk_write_bps", "net_up_bps", "net_down_bps"]
SAMPLE_COLUMNS = ["ts", "host", *METRICS, "proc_count", "cpu_temp"]
REQUIRED_COLUMNS = [c for c in SAMPLE_COLUMNS if c != "cpu_temp"]

# Columns that identify and order a sample. `sample_id` breaks ties, because (host, ts) may repeat.
ROW_KEY = ["sample_id", "host", "ts"]

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("host", T.StringType()),
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
        T.StructField("proc_count", T.IntegerType()),
        T.StructField("cpu_temp", T.DoubleType()),
    ]
)

DETECTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("metric_tags", T.StringType()),
        T.StructField("explanation", T.StringType()),
    ]
)

SCALER_SCHEMA = "idx int, feature string, mean double, scale double"
FOREST_SCHEMA = (
    "tree_id int, node_id int, feature int, threshold double, "
    "`left` int, `right` int, size int, depth int"
)

SECONDS_PER_DAY = 86400
