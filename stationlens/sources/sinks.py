"""Driver-side sinks: guarded outputs, whole-file writes, the raw archive, progress, and tables."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Serving tables and their columns.
TABLES = {
    "station_current": "station_id string, event_id string, event_time timestamp, station_name string, short_name string, bikes_available bigint, docks_available bigint, capacity bigint, source_age_seconds bigint, is_installed boolean, is_renting boolean, is_returning boolean, payload string",
    "alert_events": "alert_event_id string, alert_id string, station_id string, event_type string, lifecycle_status string, alert_type string, recommended_action string, severity string, priority_score decimal(6,2), status_changed_at timestamp, source_topic string, source_partition bigint, source_offset bigint, payload string",
    "alert_state": "alert_id string, last_event_id string, station_id string, station_name string, short_name string, alert_type string, lifecycle_status string, recommended_action string, severity string, priority_score decimal(6,2), episode_started_at timestamp, detected_at timestamp, last_observed_at timestamp, status_changed_at timestamp, resolved_at timestamp, acknowledged_at timestamp, acknowledged_by string, payload string",
    "alert_commands": "command_id string, idempotency_key string, alert_id string, command string, requested_by string, acknowledged_at timestamp, result_event_id string",
    "consumer_offsets": "topic string, partition bigint, next_offset bigint",
}


#: What the rows of a stored file are sorted by, so that look-ups and pages skip most of it.
LAYOUT = {"station_current": ["station_id"], "alert_events": ["alert_id", "status_changed_at"], "alert_state": ["alert_id"], "alert_commands": ["idempotency_key"], "consumer_offsets": ["topic", "partition"]}


def safe_output(path: str, roots: list[str]) -> Path:
    """The path, if it lies under one of the roots (and is none of them); a job that overwrites asks this first."""
    wanted = Path(path).resolve()
    if not any(root != wanted and root in wanted.parents for root in (Path(r).resolve() for r in roots)):
        raise ValueError(f"{path} is not under {', '.join(roots)}")
    return wanted


def write_json(path: str | Path, value: object) -> None:
    """A whole file or none: readers never see half of it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f".{path.name}.{os.getpid()}")
    draft.write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")
    draft.replace(path)


def archive(root: str | Path, feed: str, content: bytes, at: datetime) -> tuple[Path, bool]:
    """Keeps a raw document once, under its feed, date, second and hash; says whether it is new."""
    at = at.astimezone(UTC)
    path = Path(root) / feed / f"date={at:%Y-%m-%d}" / f"{int(at.timestamp())}-{hashlib.sha256(content).hexdigest()[:12]}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        with path.open("xb") as f:
            f.write(content)
    except FileExistsError:
        return path, False
    return path, True


class ProgressLog(StreamingQueryListener):
    """Each batch's progress as a line of JSON, for ``progress_summary``."""

    def __init__(self, path: str) -> None:
        self.path = path

    def onQueryProgress(self, event) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(event.progress.json.replace("\n", " ") + "\n")

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def create_tables(spark: SparkSession, database: str, reset: bool = False) -> None:
    if reset:
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def to_kafka(df: DataFrame, servers: str, topic: str, **options: str) -> None:
    """A batch of (key, value) to a topic, acknowledged by all replicas; needs the Kafka connector on the classpath."""
    writer = df.selectExpr("CAST(key AS string) AS key", "CAST(value AS string) AS value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("kafka.compression.type", "lz4")
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.save()
