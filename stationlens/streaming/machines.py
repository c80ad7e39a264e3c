"""Per-station state machines as plain Python, shared by the stream processors and the batch replay."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd

from stationlens.functions.rules import RuleConfig, py_priority, py_risk, py_trend

#: What alert events call their input; a fixed value of the contract's first version is given by the deployment.
INPUT_TOPIC = "station-status.v1"


def sha_parts(*parts: object) -> str:
    return hashlib.sha256("|".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()


def iso(ms: int) -> str:
    return datetime.fromtimestamp(ms // 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def millis(t: datetime) -> int:
    if t.tzinfo is None:
        t = t.replace(tzinfo=UTC)
    return int(t.timestamp() * 1000)


def canonical_json(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


@dataclass
class Episode:
    """What a station's alert machine remembers; the order of the fields is that of the state schema."""

    risk: str | None = None
    started_ms: int | None = None
    alert_id: str | None = None
    detected_ms: int | None = None
    trend: float = 0.0
    sent_score: float | None = None
    sent_ms: int | None = None
    last_ms: int = -1
    last_bikes: int = 0
    last_docks: int = 0

    SCHEMA = "risk string, started_ms bigint, alert_id string, detected_ms bigint, trend double, sent_score double, sent_ms bigint, last_ms bigint, last_bikes bigint, last_docks bigint"


class AlertMachine:
    """Turns a station's states, in order, into alert lifecycle events.

    A run of one risk opens an alert once it has lasted; an open alert is sent again when its score moved or time went by;
    it resolves when the risk changes, with the evidence of that moment. States at or before the last one are ignored.
    """

    def __init__(self, cfg: RuleConfig, source_system: str, input_topic: str = INPUT_TOPIC) -> None:
        self.cfg, self.source_system, self.input_topic = cfg, source_system, input_topic

    def step(self, e: Episode, station: str, state: dict, ms: int, partition: int, offset: int) -> list[dict]:
        if ms <= e.last_ms:
            return []
        out = []
        risk = py_risk(state, self.cfg)
        now = int(state["availability"]["bikes_available"]), int(state["availability"]["docks_available"])

        def send(kind: str, score: dict | None) -> None:
            out.append(self.event(e, kind, station, state, ms, score, partition, offset))

        if risk != e.risk and not (risk == "BALANCED" and e.risk is None):
            if e.alert_id:
                send("ALERT_RESOLVED", None)
            before = (e.last_bikes, e.last_docks) if e.last_ms >= 0 else None
            fresh = risk != "BALANCED"
            e.risk, e.started_ms = (risk, ms) if fresh else (None, None)
            e.trend = py_trend(risk, before, now) if fresh else 0.0
            e.alert_id = e.detected_ms = e.sent_score = e.sent_ms = None
        if e.risk:
            lasted = (ms - e.started_ms) // 1000
            score = py_priority(e.risk, lasted, state.get("historical_demand") or {}, e.trend, self.cfg)
            opens = e.alert_id is None and lasted >= self.cfg.persistence_seconds
            moved = self.cfg.send_updates and e.alert_id is not None and (abs(score["score"] - e.sent_score) >= self.cfg.priority_update_delta or ms - e.sent_ms >= 1000 * self.cfg.priority_update_interval_seconds)
            if opens:
                e.alert_id, e.detected_ms = sha_parts(self.source_system, station, e.risk, iso(e.started_ms)), ms
            if opens or moved:
                send("ALERT_OPENED" if opens else "ALERT_UPDATED", score)
                e.sent_score, e.sent_ms = score["score"], ms
        e.last_ms, e.last_bikes, e.last_docks = ms, *now
        return out

    def event(self, e: Episode, kind: str, station: str, state: dict, ms: int, score: dict | None, partition: int, offset: int) -> dict:
        done = kind == "ALERT_RESOLVED"
        score = score or {"action": "NONE", "severity": "INFO", "reasons": ["RISK_CLEARED"], "components": dict.fromkeys(self.cfg.weights, 0.0), "score": 0.0}
        at, place = iso(ms), state["station"]
        return {
            "schema_version": "1.0",
            "alert_event_id": sha_parts(e.alert_id, kind, at),
            "alert_id": e.alert_id,
            "event_type": kind,
            "lifecycle_status": "RESOLVED" if done else "OPEN",
            "alert_type": e.risk,
            "recommended_action": score["action"],
            "severity": score["severity"],
            "station": {"station_id": station, "short_name": place.get("short_name"), "name": place.get("name")},
            "time": {"episode_started_at_utc": iso(e.started_ms), "detected_at_utc": iso(e.detected_ms), "status_changed_at_utc": at, "last_observed_at_utc": at, "resolved_at_utc": at if done else None},
            "evidence": {
                "risk_duration_seconds": max(0, (ms - e.started_ms) // 1000),
                **{k: int(state["availability"][k]) for k in ("bikes_available", "docks_available")},
                **{k: bool(state["service"][k]) for k in ("is_renting", "is_returning")},
                "source_age_seconds": state.get("source_age_seconds"),
                "reason_codes": score["reasons"],
            },
            "priority": {"score": score["score"], "rule_version": self.cfg.rule_version, "components": score["components"]},
            "lineage": {"triggering_event_id": state["event_id"], "input_topic": self.input_topic, "input_partition": int(partition), "input_offset": int(offset), "generated_at_utc": at},
        }


def acknowledged(event: dict, at: str) -> dict:
    """The acknowledgement of an active alert's latest event."""
    if event["lifecycle_status"] not in ("OPEN", "ACKNOWLEDGED"):
        raise ValueError("only an active alert can be acknowledged")
    return event | {
        "event_type": "ALERT_ACKNOWLEDGED",
        "lifecycle_status": "ACKNOWLEDGED",
        "alert_event_id": sha_parts(event["alert_id"], "ALERT_ACKNOWLEDGED", at),
        "time": event["time"] | {"status_changed_at_utc": at, "last_observed_at_utc": at},
        "lineage": event["lineage"] | {"generated_at_utc": at},
    }


def replay_batches(cfg: RuleConfig, source_system: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For sorted partitions of whole stations: their states -> their lifecycle events, a batch at a time.

    An event id counts once while it is within the deduplication time of the station's newest state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, station, e, seen = AlertMachine(cfg, source_system), None, Episode(), {}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.station_id != station:
                    station, e, seen = r.station_id, Episode(), {}
                ms = millis(r.event_time.to_pydatetime())
                if r.event_id in seen:
                    continue
                seen[r.event_id] = ms
                if len(seen) > 10_000:
                    seen = {k: v for k, v in seen.items() if v >= ms - 1000 * cfg.dedup_ttl_seconds}
                for x in machine.step(e, station, json.loads(r.current_state_json), ms, 0, r.input_offset):
                    rows.append((station, x["alert_id"], x["alert_event_id"], r.event_time, x["event_type"], x["lifecycle_status"], float(x["priority"]["score"]), canonical_json(x)))
            yield pd.DataFrame(rows, columns=["station_id", "alert_id", "alert_event_id", "event_time", "event_type", "lifecycle_status", "priority_score", "alert_json"])

    return run
