"""Risk rules: classification, onset trend, priority. Native columns for batch plans, plain Python inside stream state.

The two forms share the tables below; ``tests/test_rules.py`` holds them against each other. They differ only in how a
half is rounded (``round`` is half-even on binary doubles in Python, half-up in Spark).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Risk -> (recommended action, first reason, severity, severity score, service impact): fixed values.
RISKS = {
    "EMPTY": ("DELIVER_BIKES", "EMPTY_PERSISTED", "CRITICAL", 100.0, 100.0),
    "LOW_BIKES": ("DELIVER_BIKES", "LOW_BIKES_PERSISTED", "WARNING", 60.0, 60.0),
    "LOW_DOCKS": ("REMOVE_BIKES", "LOW_DOCKS_PERSISTED", "WARNING", 60.0, 60.0),
    "FULL": ("REMOVE_BIKES", "FULL_PERSISTED", "CRITICAL", 100.0, 100.0),
    "STALE": ("INSPECT_STATION", "SOURCE_STALE", "WARNING", 80.0, 60.0),
    "OFFLINE": ("INSPECT_STATION", "STATION_OFFLINE", "CRITICAL", 90.0, 100.0),
    "DATA_QUALITY": ("INSPECT_STATION", "DATA_QUALITY_RISK", "WARNING", 50.0, 60.0),
}
BIKE_RISKS, DOCK_RISKS = ("EMPTY", "LOW_BIKES"), ("FULL", "LOW_DOCKS")
COMPONENTS = ("severity", "persistence", "historical_demand", "recent_trend", "service_impact")


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds and weights; the defaults are the first published rule set (fixed values)."""

    rule_version: str = "business-rules-1.0"
    persistence_seconds: int = 300
    stale_after_seconds: int = 180
    low_bikes_threshold: int = 2
    low_docks_threshold: int = 2
    dedup_ttl_seconds: int = 86400
    watermark_delay: str = "10 minutes"
    priority_update_delta: float = 5.0
    priority_update_interval_seconds: int = 300
    high_demand_p95_reference: float = 5.0
    rapid_trend_threshold: float = 60.0
    weights: dict[str, float] = field(default_factory=lambda: dict(zip(COMPONENTS, (0.4, 0.2, 0.2, 0.1, 0.1), strict=True)))
    #: "linear" is the older persistence score, 60 at the persistence time and in proportion to the duration.
    persistence_form: str = "stepped"
    #: Whether an open alert is sent again when its score moves; the older form only opens and resolves.
    send_updates: bool = True

    def __post_init__(self) -> None:
        if set(self.weights) != set(COMPONENTS):
            raise ValueError(f"weights must be given for {', '.join(COMPONENTS)} and nothing else")
        if abs(sum(self.weights.values()) - 1) > 1e-9:
            raise ValueError("weights must add up to 1")
        if min(self.persistence_seconds, self.high_demand_p95_reference) <= 0:
            raise ValueError("persistence and the demand reference must be positive")

    @classmethod
    def load(cls, text: str) -> RuleConfig:
        return cls(**json.loads(text))


# ---------------------------------------------------------------- columns


def risk(bikes: Column, docks: Column, *, stale: Column, offline: Column, doubtful: Column, cfg: RuleConfig) -> Column:
    """A station's risk: staleness outranks being offline, that doubtful data, and that availability."""
    return (
        F.when(stale, "STALE")
        .when(offline, "OFFLINE")
        .when(doubtful | ((bikes == 0) & (docks == 0)), "DATA_QUALITY")
        .when(bikes == 0, "EMPTY")
        .when(docks == 0, "FULL")
        .when(bikes <= cfg.low_bikes_threshold, "LOW_BIKES")
        .when(docks <= cfg.low_docks_threshold, "LOW_DOCKS")
        .otherwise("BALANCED")
    )


def is_stale(source_age: Column, issue_codes: Column | None, cfg: RuleConfig) -> Column:
    old = F.coalesce(source_age > cfg.stale_after_seconds, F.lit(False))
    return old if issue_codes is None else old | F.array_contains(issue_codes, "SOURCE_STALE")


def onset_trend(risk_: Column, before_bikes: Column, before_docks: Column, bikes: Column, docks: Column) -> Column:
    """The drop since the previous observation, in percent of it, of what the risk is about; 0 without one."""
    drop = lambda before, now: F.round(100.0 * F.greatest(F.lit(0), before - now) / F.greatest(before, F.lit(1)), 2)
    return F.coalesce(F.when(risk_.isin(*BIKE_RISKS), drop(before_bikes, bikes)).when(risk_.isin(*DOCK_RISKS), drop(before_docks, docks)), F.lit(0.0))


def of_risk(risk_: Column, which: int) -> Column:
    """A column of the risk table: 0 action, 1 reason, 2 severity, 3 severity score, 4 service impact."""
    pairs = [F.lit(x) for name, row in RISKS.items() for x in (name, row[which])]
    return F.try_element_at(F.create_map(*pairs), risk_)


def priority(risk_: Column, duration: Column, found: Column, p95_pickups: Column, p95_dropoffs: Column, trend: Column, cfg: RuleConfig) -> Column:
    """struct(level, action, reasons, the five components, score)."""
    p = float(cfg.persistence_seconds)
    stepped = 60.0 + 40.0 * F.greatest(F.lit(0.0), duration - p) / p
    persistence = F.least(F.lit(100.0), stepped if cfg.persistence_form == "stepped" else 60.0 * duration / p)
    about_bikes, about_docks = risk_.isin(*BIKE_RISKS), risk_.isin(*DOCK_RISKS)
    demand = F.when(found & about_bikes, F.coalesce(p95_pickups.cast("double"), F.lit(0.0))).when(found & about_docks, F.coalesce(p95_dropoffs.cast("double"), F.lit(0.0))).otherwise(0.0)
    demand_score = F.least(F.lit(100.0), 100.0 * demand / cfg.high_demand_p95_reference)
    trend_score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), trend))
    parts = dict(zip(COMPONENTS, (F.round(x.cast("double").cast("decimal(20,10)"), 2).cast("double") for x in (of_risk(risk_, 3), persistence, demand_score, trend_score, of_risk(risk_, 4))), strict=True))
    busy, rapid = found & (demand_score >= 80.0), trend_score >= cfg.rapid_trend_threshold
    reasons = F.array_compact(
        F.array(
            of_risk(risk_, 1),
            F.when(busy & about_bikes, "HIGH_HISTORICAL_PICKUP_DEMAND").when(busy & about_docks, "HIGH_HISTORICAL_DROPOFF_DEMAND"),
            F.when(rapid & about_bikes, "RAPID_OUTFLOW").when(rapid & about_docks, "RAPID_INFLOW"),
        )
    )
    # in decimals, so that a half is a half in any engine
    weighted = (F.lit(Decimal(str(cfg.weights[name]))) * part.cast("decimal(7,2)") for name, part in parts.items())
    score = F.round(reduce(lambda a, b: a + b, weighted), 2).cast("double")
    return F.struct(of_risk(risk_, 2).alias("level"), of_risk(risk_, 0).alias("action"), reasons.alias("reasons"), *(c.alias(n) for n, c in parts.items()), score.alias("score"))


# ---------------------------------------------------------------- plain Python, for keyed state


def py_risk(state: dict, cfg: RuleConfig) -> str:
    """The risk of a current-state document."""
    age, quality, service = state.get("source_age_seconds"), state["quality"], state["service"]
    bikes, docks = int(state["availability"]["bikes_available"]), int(state["availability"]["docks_available"])
    chain = (
        ("STALE", "SOURCE_STALE" in quality["issue_codes"] or (age is not None and age > cfg.stale_after_seconds)),
        ("OFFLINE", not all(service[k] for k in ("is_installed", "is_renting", "is_returning"))),
        ("DATA_QUALITY", quality["timestamp_status"] != "VALID" or state["station"]["metadata_match_status"] == "UNMATCHED" or bikes == docks == 0),
        ("EMPTY", bikes == 0),
        ("FULL", docks == 0),
        ("LOW_BIKES", bikes <= cfg.low_bikes_threshold),
        ("LOW_DOCKS", docks <= cfg.low_docks_threshold),
    )
    return next((name for name, holds in chain if holds), "BALANCED")


def py_trend(risk_: str, before: tuple[int, int] | None, now: tuple[int, int]) -> float:
    """``before`` and ``now``: (bikes, docks)."""
    which = 0 if risk_ in BIKE_RISKS else 1 if risk_ in DOCK_RISKS else None
    if which is None or before is None:
        return 0.0
    return round(100.0 * max(0, before[which] - now[which]) / max(before[which], 1), 2)


def py_priority(risk_: str, duration: int, demand: dict, trend: float, cfg: RuleConfig) -> dict:
    """The same as ``priority`` for one alert: action, severity, reasons, components, score."""
    action, reason, severity, severity_score, impact = RISKS[risk_]
    side = "pickups" if risk_ in BIKE_RISKS else "dropoffs" if risk_ in DOCK_RISKS else None
    p = cfg.persistence_seconds
    held = 60.0 + 40.0 * max(0, duration - p) / p if cfg.persistence_form == "stepped" else 60.0 * duration / p
    busy = min(100.0, 100.0 * float((side and demand.get("found") and demand.get(f"p95_{side}")) or 0) / cfg.high_demand_p95_reference)
    trend = min(100.0, max(0.0, float(trend)))
    reasons = [reason]
    if side and demand.get("found") and busy >= 80:
        reasons.append(f"HIGH_HISTORICAL_{side[:-1].upper()}_DEMAND")
    if side and trend >= cfg.rapid_trend_threshold:
        reasons.append("RAPID_OUTFLOW" if side == "pickups" else "RAPID_INFLOW")
    parts = {n: round(x, 2) for n, x in zip(COMPONENTS, (severity_score, min(100.0, held), busy, trend, impact), strict=True)}
    return {"action": action, "severity": severity, "reasons": reasons, "components": parts, "score": round(sum(cfg.weights[n] * x for n, x in parts.items()), 2)}
