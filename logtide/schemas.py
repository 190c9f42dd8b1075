"""Schemas of log records, manifests and their companions."""

from __future__ import annotations

RECORD = "timestamp LONG, stream STRING, message STRING, ingestion_time LONG, event_id STRING"
PARTITIONS = "account STRING, loggroup STRING, dt STRING"
CORRUPT = "_corrupt"
OBJECT = (
    "STRUCT<data_key: STRING, etag: STRING, crc32c: LONG, body_len: LONG, raw_bytes: LONG, storage_class: STRING, record_count: LONG, min_ts: LONG, max_ts: LONG>"
)
MANIFEST = (
    f"version LONG, account STRING, log_group STRING, window_start_ms LONG, window_end_ms LONG, objects ARRAY<{OBJECT}>, "
    "record_count LONG, completed_at_ms LONG, drain_version STRING, reconciled_at_ms LONG, reconciled_added LONG"
)
GROUPS = "log_group STRING, creation_time_ms LONG, retention_days INT, stored_bytes LONG"
RULES = "rule_idx INT, group_glob STRING, stream_glob STRING, action STRING"
REQUEST = "logGroupName STRING, logStreamName STRING, logEvents ARRAY<STRUCT<timestamp: LONG, message: STRING>>, sequenceToken STRING"
