"""Schemas of the records that enter as JSON text, and the logical tables' key columns."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, STRINGS = T.StringType(), T.ArrayType(T.StringType())
RAW_LOG = _struct(service=STRING, level=STRING, message=STRING, trace_id=STRING, timestamp=STRING,
                  metadata=T.MapType(STRING, STRING), _corrupt=STRING)
STEP = _struct(step_number=T.IntegerType(), thought=STRING, action=STRING, action_input=STRING,
               observation=STRING, timestamp=STRING)
RCA_OUTPUT = _struct(root_cause=STRING, confidence=T.DoubleType(), recommendations=STRINGS, _corrupt=STRING)
ALERT = _struct(alert_id=STRING, tenant_id=STRING, service=STRING, anomaly_type=STRING, severity=STRING,
                confidence=T.DoubleType(), created_at=T.TimestampType())

# Keys a message must carry, per stream.
REQUIRED_FIELDS = {
    "alerts": ["alert_id", "tenant_id", "service", "anomaly_type", "severity"],
    "incidents": ["incident_id", "tenant_id", "affected_services"],
}
# Accepted log levels.
LOG_LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
