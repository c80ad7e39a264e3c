"""Builders of station records for the stream and rule tests."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime, timedelta

SOURCE = "station_feed"
NOON = datetime(2026, 5, 13, 12, 0, tzinfo=UTC)


def sha(x: object) -> str:
    return hashlib.sha256(str(x).encode()).hexdigest()


def iso(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


#: The records' fields and constants are those of the contract: fixed names and values.
def observation(station: str, minute: float, bikes: int, docks: int = 10, /, **changes) -> dict:
    at = iso(NOON + timedelta(minutes=minute))
    record = {
        "schema_version": "1.0", "event_id": sha((station, minute, bikes)), "event_type": "STATION_STATUS_OBSERVED", "source_system": SOURCE,
        "station": {"station_id": station, "short_name": f"{station}.1", "name": station.title(), "latitude": 40.7, "longitude": -74.0, "capacity": 20, "metadata_match_status": "MATCHED_BY_STATION_ID"},
        "availability": {"bikes_available": bikes, "bikes_disabled": 0, "docks_available": docks, "docks_disabled": 0, "ebikes_available": None},
        "service": {"is_installed": True, "is_renting": True, "is_returning": True},
        "time": {"snapshot_updated_at_utc": at, "station_reported_at_raw": None, "station_reported_at_utc": None, "observed_at_utc": at, "normalized_at_utc": at, "source_age_seconds": 5},
        "source": {"feed_name": "station_status", "feed_version": "2.3", "feed_ttl_seconds": 60, "snapshot_sha256": sha(minute), "raw_archive_path": "x"},
        "quality": {"timestamp_status": "VALID", "capacity_consistency": "EXACT", "issue_codes": []},
    }
    return record | changes


def state(station: str, minute: float, bikes: int = 10, docks: int = 10, p95: int = 0, age: int = 5, renting: bool = True) -> dict:
    o = observation(station, minute, bikes, docks)
    return {
        "schema_version": "1.0", "station_id": station, "event_id": sha((station, minute, bikes, docks)), "event_time_utc": o["time"]["snapshot_updated_at_utc"], "station": o["station"], "availability": o["availability"],
        "service": o["service"] | {"is_renting": renting}, "quality": o["quality"], "source_age_seconds": age,
        "historical_demand": {"found": p95 > 0, "iso_weekday": 1, "local_hour": 8, "calendar_days": 4, "avg_pickups": 1.0, "p50_pickups": 1, "p95_pickups": p95, "avg_dropoffs": 1.0, "p50_dropoffs": 1, "p95_dropoffs": p95},
        "lineage": {"input_partition": 0, "input_offset": 0},
    }


def put_files(folder: str, batches: list[list], start: int = 0) -> None:
    """A file a batch, their times in order, so that the file source reads them in order."""
    os.makedirs(folder, exist_ok=True)
    for k, batch in enumerate(batches, start):
        path = f"{folder}/batch-{k:03d}.json"
        with open(path, "w") as f:
            f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in batch)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
