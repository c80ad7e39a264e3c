"""Schemas of the station streams and the rules that name what is wrong with a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlens.functions.expr import codes, missing_or

_STATION = "station: struct<station_id: string, short_name: string, name: string, latitude: double, longitude: double, capacity: bigint, metadata_match_status: string>"
_AVAILABILITY = "availability: struct<bikes_available: bigint, bikes_disabled: bigint, docks_available: bigint, docks_disabled: bigint, ebikes_available: bigint>"
_SERVICE = "service: struct<is_installed: boolean, is_renting: boolean, is_returning: boolean>"
_QUALITY = "quality: struct<timestamp_status: string, capacity_consistency: string, issue_codes: array<string>>"
_TIME = "time: struct<snapshot_updated_at_utc: string, station_reported_at_raw: bigint, station_reported_at_utc: string, observed_at_utc: string, normalized_at_utc: string, source_age_seconds: bigint>"
_SOURCE = "source: struct<feed_name: string, feed_version: string, feed_ttl_seconds: bigint, snapshot_sha256: string, raw_archive_path: string>"
_DEMAND = "historical_demand: struct<found: boolean, iso_weekday: bigint, local_hour: bigint, calendar_days: bigint, avg_pickups: double, p50_pickups: bigint, p95_pickups: bigint, avg_dropoffs: double, p50_dropoffs: bigint, p95_dropoffs: bigint>"
OBSERVATION = f"struct<schema_version: string, event_id: string, event_type: string, source_system: string, {_STATION}, {_AVAILABILITY}, {_SERVICE}, {_TIME}, {_SOURCE}, {_QUALITY}>"
CURRENT_STATE = f"struct<schema_version: string, station_id: string, event_id: string, event_time_utc: string, {_STATION}, {_AVAILABILITY}, {_SERVICE}, {_QUALITY}, source_age_seconds: bigint, {_DEMAND}, lineage: struct<input_partition: bigint, input_offset: bigint>>"
ALERT = (
    "struct<schema_version: string, alert_event_id: string, alert_id: string, event_type: string, lifecycle_status: string, alert_type: string, recommended_action: string, severity: string, "
    "station: struct<station_id: string, short_name: string, name: string>, time: struct<episode_started_at_utc: string, detected_at_utc: string, status_changed_at_utc: string, last_observed_at_utc: string, resolved_at_utc: string>, "
    "evidence: struct<risk_duration_seconds: bigint, bikes_available: bigint, docks_available: bigint, is_renting: boolean, is_returning: boolean, source_age_seconds: bigint, reason_codes: array<string>>, "
    "priority: struct<score: double, rule_version: string, components: map<string, double>>, lineage: struct<triggering_event_id: string, input_topic: string, input_partition: bigint, input_offset: bigint, generated_at_utc: string>>"
)
#: The name a deployment gives its feed; part of identities, so it must be the same for all its jobs.
SOURCE_SYSTEM = "station_feed"
FEED_VERSIONS = ("1.1", "2.3")
_SHA = "^[a-f0-9]{64}$"


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _absent(c: Column, *fields: str) -> Column:
    return _any(c.isNull(), *(c[f].isNull() for f in fields))


def observation_errors(o: Column, event_time: Column, key: Column, source_system: str = SOURCE_SYSTEM) -> Column:
    a, station = o["availability"], o["station"]
    counts = ("bikes_available", "bikes_disabled", "docks_available", "docks_disabled")
    negative = _any(*(a[f] < 0 for f in (*counts, "ebikes_available")))
    return codes(
        (missing_or(o["schema_version"], o["schema_version"] != "1.0"), "SCHEMA_VERSION_INVALID"),
        (missing_or(o["event_id"], ~o["event_id"].rlike(_SHA)), "EVENT_ID_INVALID"),
        (missing_or(o["event_type"], o["event_type"] != "STATION_STATUS_OBSERVED"), "EVENT_TYPE_INVALID"),
        (missing_or(o["source_system"], o["source_system"] != source_system), "SOURCE_SYSTEM_INVALID"),
        (_absent(station, "station_id") | (F.length(station["station_id"]) == 0), "STATION_ID_MISSING"),
        (_absent(a, *counts) | negative, "AVAILABILITY_INVALID"),
        (_absent(o["service"], "is_installed", "is_renting", "is_returning"), "SERVICE_FLAGS_INVALID"),
        (event_time.isNull(), "EVENT_TIME_INVALID"),
        (_absent(o["source"], "feed_version", "snapshot_sha256") | ~o["source"]["feed_version"].isin(*FEED_VERSIONS) | ~o["source"]["snapshot_sha256"].rlike(_SHA), "SOURCE_LINEAGE_INVALID"),
        (_absent(o["quality"], "timestamp_status", "capacity_consistency", "issue_codes"), "QUALITY_INVALID"),
        (key != station["station_id"], "KAFKA_KEY_STATION_MISMATCH"),
    )


#: What a published observation may say: fixed values of the contract.
MATCHES = ("MATCHED_BY_STATION_ID", "UNMATCHED")
TIMESTAMP_STATES = ("VALID", "SENTINEL", "MISSING", "FUTURE", "OUT_OF_RANGE")
CAPACITY_STATES = ("EXACT", "MISMATCH", "NOT_EVALUATED")
ISSUES = ("SOURCE_TIMESTAMP_SENTINEL", "SOURCE_TIMESTAMP_MISSING", "SOURCE_TIMESTAMP_FUTURE", "SOURCE_TIMESTAMP_OUT_OF_RANGE", "SOURCE_STALE", "METADATA_UNMATCHED", "CAPACITY_MISMATCH")


def publication_errors(o: Column, source_system: str = SOURCE_SYSTEM) -> Column:
    """What the full contract has against an observation that is to be published: the paths of wrong fields, in order."""
    station, a, q, source, time = (o[c] for c in ("station", "availability", "quality", "source", "time"))
    outside = lambda c, low, high: c.isNotNull() & ~c.between(low, high)
    unknown = lambda c, known: missing_or(c, ~c.isin(*known))
    instant = lambda c: F.try_to_timestamp(c).isNull()
    return codes(
        (missing_or(o["schema_version"], o["schema_version"] != "1.0"), "schema_version"),
        (missing_or(o["event_id"], ~o["event_id"].rlike(_SHA)), "event_id"),
        (missing_or(o["event_type"], o["event_type"] != "STATION_STATUS_OBSERVED"), "event_type"),
        (missing_or(o["source_system"], o["source_system"] != source_system), "source_system"),
        (missing_or(station["station_id"], F.length(station["station_id"]) == 0), "station.station_id"),
        (outside(station["latitude"], -90, 90), "station.latitude"),
        (outside(station["longitude"], -180, 180), "station.longitude"),
        (station["capacity"] < 0, "station.capacity"),
        (unknown(station["metadata_match_status"], MATCHES), "station.metadata_match_status"),
        *((missing_or(a[c], a[c] < 0), f"availability.{c}") for c in ("bikes_available", "bikes_disabled", "docks_available", "docks_disabled")),
        (a["ebikes_available"] < 0, "availability.ebikes_available"),
        *((o["service"][c].isNull(), f"service.{c}") for c in ("is_installed", "is_renting", "is_returning")),
        *((instant(time[c]), f"time.{c}") for c in ("snapshot_updated_at_utc", "observed_at_utc", "normalized_at_utc")),
        (time["station_reported_at_raw"] < 0, "time.station_reported_at_raw"),
        (time["station_reported_at_utc"].isNotNull() & instant(time["station_reported_at_utc"]), "time.station_reported_at_utc"),
        (time["source_age_seconds"] < 0, "time.source_age_seconds"),
        (missing_or(source["feed_name"], source["feed_name"] != "station_status"), "source.feed_name"),
        (unknown(source["feed_version"], FEED_VERSIONS), "source.feed_version"),
        (source["feed_ttl_seconds"] < 0, "source.feed_ttl_seconds"),
        (missing_or(source["snapshot_sha256"], ~source["snapshot_sha256"].rlike(_SHA)), "source.snapshot_sha256"),
        (missing_or(source["raw_archive_path"], F.length(source["raw_archive_path"]) == 0), "source.raw_archive_path"),
        (unknown(q["timestamp_status"], TIMESTAMP_STATES), "quality.timestamp_status"),
        (unknown(q["capacity_consistency"], CAPACITY_STATES), "quality.capacity_consistency"),
        (q["issue_codes"].isNull() | (F.size(F.array_distinct(q["issue_codes"])) < F.size(q["issue_codes"])) | (F.size(F.array_except(q["issue_codes"], F.array(*map(F.lit, ISSUES)))) > 0), "quality.issue_codes"),
    )


def required_state_errors(s: Column) -> Column:
    """What a serving table demands of a current state before it is stored."""
    absent = ("schema_version", "station_id", "event_id", "event_time_utc", "station", "availability", "service")
    return codes(*((s[c].isNull(), f"MISSING_{c.upper()}") for c in absent), (~s["station_id"].eqNullSafe(s["station"]["station_id"]), "STATION_ID_MISMATCH"))


def request_errors(command: Column) -> Column:
    """What is wrong with an acknowledge request (idempotency_key, requested_by, acknowledged_at_utc as text, may be null)."""
    at = command["acknowledged_at_utc"]
    zoned = at.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(at).isNotNull()
    between = lambda c, low, high: missing_or(c, ~F.length(c).between(low, high))
    return codes((between(command["idempotency_key"], 8, 128), "IDEMPOTENCY_KEY_INVALID"), (between(command["requested_by"], 1, 128), "REQUESTED_BY_INVALID"), (at.isNotNull() & ~zoned, "ACKNOWLEDGED_AT_INVALID"))


def current_state_errors(s: Column, event_time: Column, key: Column) -> Column:
    return codes(
        (missing_or(s["schema_version"], s["schema_version"] != "1.0"), "SCHEMA_VERSION_INVALID"),
        (missing_or(s["station_id"], s["station_id"] != s["station"]["station_id"]), "STATION_ID_INVALID"),
        (key != s["station_id"], "KAFKA_KEY_STATION_MISMATCH"),
        (missing_or(s["event_id"], ~s["event_id"].rlike(_SHA)), "EVENT_ID_INVALID"),
        (event_time.isNull(), "EVENT_TIME_INVALID"),
        (_absent(s["availability"], "bikes_available", "docks_available"), "AVAILABILITY_INVALID"),
        (_absent(s["service"], "is_installed", "is_renting", "is_returning"), "SERVICE_INVALID"),
        (_absent(s["quality"], "timestamp_status", "issue_codes"), "QUALITY_INVALID"),
        (_absent(s["historical_demand"], "found"), "BASELINE_CONTEXT_MISSING"),
    )


def alert_errors(a: Column) -> Column:
    """Conditional rules of alert events: what each event type and status demand of the others."""
    resolved, when_resolved = a["lifecycle_status"] == "RESOLVED", a["time"]["resolved_at_utc"]
    expected = {"ALERT_OPENED": "OPEN", "ALERT_UPDATED": "OPEN", "ALERT_ACKNOWLEDGED": "ACKNOWLEDGED", "ALERT_RESOLVED": "RESOLVED"}
    status = F.try_element_at(F.create_map(*(F.lit(x) for kv in expected.items() for x in kv)), a["event_type"])
    counts = ("risk_duration_seconds", "bikes_available", "docks_available")
    return codes(
        (status.isNull(), "EVENT_TYPE_INVALID"),
        (missing_or(a["lifecycle_status"], a["lifecycle_status"] != status), "LIFECYCLE_STATUS_INVALID"),
        (resolved & _any(a["recommended_action"] != "NONE", a["severity"] != "INFO", when_resolved.isNull()), "RESOLUTION_INVALID"),
        (~resolved & when_resolved.isNotNull(), "RESOLVED_AT_UNEXPECTED"),
        (_any(*(missing_or(a["alert_id"], ~a["alert_id"].rlike(_SHA)), missing_or(a["alert_event_id"], ~a["alert_event_id"].rlike(_SHA)))), "IDENTITY_INVALID"),
        (_absent(a["evidence"], *counts) | _any(*(a["evidence"][f] < 0 for f in counts)), "EVIDENCE_INVALID"),
        (missing_or(a["priority"]["score"], ~a["priority"]["score"].between(0, 100)), "SCORE_INVALID"),
    )


def parse_records(raw: DataFrame, schema: str, time_path: str, errors, malformed: str) -> DataFrame:
    """Records (key, body, origin) -> input_key, raw_value, the lineage that outputs carry, ``record``, ``event_time``, ``error_codes``, ``is_valid``.

    A malformed record has that code alone. A bad time is null and named; it does not fail the query.
    """
    lineage = [F.col(f"origin.{c}").alias(f"input_{c}") for c in ("topic", "partition", "offset")]
    parsed = raw.select(F.col("key").alias("input_key"), F.col("body").alias("raw_value"), *lineage).withColumn("record", F.from_json("raw_value", schema)).withColumn("event_time", F.try_to_timestamp(F.col(f"record.{time_path}")))
    found = F.when(F.get_json_object("raw_value", "$").isNull(), F.array(F.lit(malformed))).otherwise(errors(F.col("record"), F.col("event_time"), F.col("input_key")))
    return parsed.withColumn("error_codes", found).withColumn("is_valid", F.size("error_codes") == 0)


def parse_observations(raw: DataFrame, source_system: str = SOURCE_SYSTEM) -> DataFrame:
    return parse_records(raw, OBSERVATION, "time.snapshot_updated_at_utc", lambda r, t, k: observation_errors(r, t, k, source_system), "MALFORMED_JSON")


def parse_current_states(raw: DataFrame) -> DataFrame:
    return parse_records(raw, CURRENT_STATE, "event_time_utc", current_state_errors, "MALFORMED_CURRENT_STATE")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """What is kept of an invalid record: key (its hash without one), codes, hash, the first 1000 characters, lineage."""
    digest = F.sha2("raw_value", 256)
    return parsed.filter(~F.col("is_valid")).select(
        F.coalesce("input_key", digest).alias("record_key"), "error_codes", digest.alias("raw_sha256"),
        F.substring("raw_value", 1, 1000).alias("raw_fragment"), "input_topic", "input_partition", "input_offset",
    )
