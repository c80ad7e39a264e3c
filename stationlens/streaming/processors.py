"""Keyed stream operators: the latest state a station, and its alert lifecycle."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stationlens.functions.rules import RuleConfig
from stationlens.session import ship
from stationlens.streaming.machines import AlertMachine, Episode, canonical_json, millis

LATEST = "station_id string, event_id string, event_time timestamp, current_state_json string, input_partition bigint, input_offset bigint"
ALERTS = "station_id string, alert_id string, alert_event_id string, event_time timestamp, event_type string, lifecycle_status string, recommended_action string, priority_score double, alert_json string, input_partition bigint, input_offset bigint"
_DEMAND = ("calendar_days", "avg_pickups", "p50_pickups", "p95_pickups", "avg_dropoffs", "p50_dropoffs", "p95_dropoffs")


class _Ordered(StatefulProcessor):
    """Hands a key's rows on in the order of event time and offset, each event id once.

    Ids are forgotten once they are older than ``ttl`` seconds before the newest row of a batch of their key.
    """

    ttl = 86400

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event_id string", "event_ms bigint")

    def fresh(self, rows: Iterator[Row]) -> Iterator[tuple[Row, int]]:
        ordered = sorted(rows, key=lambda r: (r.event_time, r.input_offset))
        if not ordered:
            return
        oldest = millis(ordered[-1].event_time) - 1000 * self.ttl
        for key in [k for k, v in self.seen.iterator() if v[0] < oldest]:
            self.seen.removeKey(key)
        for r in ordered:
            if not self.seen.containsKey((r.event_id,)):
                ms = millis(r.event_time)
                self.seen.updateValue((r.event_id,), (ms,))
                yield r, ms

    def close(self) -> None:
        pass


class LatestState(_Ordered):
    """A document for each observation that is newer than the station's last."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "event_ms bigint, event_id string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = int(self.last.get()[0]) if self.last.exists() else None
        for r, ms in self.fresh(rows):
            if last is not None and ms <= last:
                continue
            last = ms
            self.last.update((ms, r.event_id))
            o = json.loads(r.observation_json)
            demand = {"found": r.calendar_days is not None, "iso_weekday": r.iso_weekday, "local_hour": r.local_hour} | {c: getattr(r, c) for c in _DEMAND}
            state = {
                "schema_version": "1.0", "station_id": key[0], "event_id": r.event_id, "event_time_utc": r.event_time_utc,
                **{k: o.get(k) for k in ("station", "availability", "service", "quality")},
                "source_age_seconds": (o.get("time") or {}).get("source_age_seconds"), "historical_demand": demand,
                "lineage": {"input_partition": r.input_partition, "input_offset": r.input_offset},
            }
            yield Row(station_id=key[0], event_id=r.event_id, event_time=r.event_time, current_state_json=canonical_json(state), input_partition=r.input_partition, input_offset=r.input_offset)


class AlertLifecycle(_Ordered):
    """The alert machine over a station's states."""

    def __init__(self, cfg: RuleConfig, source_system: str) -> None:
        self.ttl, self.machine = cfg.dedup_ttl_seconds, AlertMachine(cfg, source_system)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.episode = handle.getValueState("episode", Episode.SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        e = Episode(*self.episode.get()) if self.episode.exists() else Episode()
        for r, ms in self.fresh(rows):
            for x in self.machine.step(e, key[0], json.loads(r.current_state_json), ms, r.input_partition, r.input_offset):
                yield Row(
                    station_id=key[0], alert_id=x["alert_id"], alert_event_id=x["alert_event_id"], event_time=r.event_time, event_type=x["event_type"], lifecycle_status=x["lifecycle_status"],
                    recommended_action=x["recommended_action"], priority_score=float(x["priority"]["score"]), alert_json=canonical_json(x), input_partition=r.input_partition, input_offset=r.input_offset,
                )
        self.episode.update((e.risk, e.started_ms, e.alert_id, e.detected_ms, e.trend, e.sent_score, e.sent_ms, e.last_ms, e.last_bikes, e.last_docks))


def latest_states(events: DataFrame, dedup_ttl_seconds: int = 86400) -> DataFrame:
    """Valid observations with baseline context (and a watermark on event_time) -> current-state documents."""
    ship(events.sparkSession)
    return events.groupBy("station_id").transformWithState(statefulProcessor=LatestState(dedup_ttl_seconds), outputStructType=LATEST, outputMode="Update", timeMode="EventTime", eventTimeColumnName="event_time")


def alert_events(states: DataFrame, cfg: RuleConfig, source_system: str) -> DataFrame:
    """Valid current states (with a watermark on event_time) -> alert lifecycle events."""
    ship(states.sparkSession)
    return states.groupBy("station_id").transformWithState(statefulProcessor=AlertLifecycle(cfg, source_system), outputStructType=ALERTS, outputMode="Update", timeMode="EventTime", eventTimeColumnName="event_time")
