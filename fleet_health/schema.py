"""Column names and struct types of the telemetry data model."""

from __future__ import annotations

from pyspark.sql import types as T

HOST = "host_id"
SAMPLE = "sample_id"
TS = "timestamp"
LABEL = "is_anomaly"

# Order of rows inside one host series: event time, then a unique id.
SERIES_ORDER = (TS, SAMPLE)

CPU = "cpu_percent"
MEM = "memory_percent"
MEM_USED = "memory_used_gb"
MEM_AVAIL = "memory_available_gb"
DISK = "disk_usage_percent"
DISK_USED = "disk_used_gb"
DISK_FREE = "disk_free_gb"

METRIC_COLUMNS = [CPU, MEM, MEM_USED, MEM_AVAIL, DISK, DISK_USED, DISK_FREE]
# The five metrics all trainers derive features from.
BASE_FEATURES = [CPU, MEM, MEM_USED, DISK, DISK_USED]

# One sample as it travels on the wire (JSON object, ISO timestamp text).
WIRE_SCHEMA = T.StructType(
    [T.StructField(TS, T.StringType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in METRIC_COLUMNS]
)

# Wire sample with the fleet key (the reference has a single host).
FLEET_WIRE_SCHEMA = T.StructType(
    [T.StructField(HOST, T.LongType(), True),
     T.StructField(SAMPLE, T.LongType(), True)] + WIRE_SCHEMA.fields
)

# Table at rest.
METRICS_SCHEMA = T.StructType(
    [T.StructField(HOST, T.LongType(), False),
     T.StructField(SAMPLE, T.LongType(), False),
     T.StructField(TS, T.TimestampNTZType(), False)]
    + [T.StructField(c, T.DoubleType(), True) for c in METRIC_COLUMNS]
)

LABELED_SCHEMA = T.StructType(
    METRICS_SCHEMA.fields + [T.StructField(LABEL, T.IntegerType(), True)])

ALERT_LEVELS = ("info", "warning", "critical")
