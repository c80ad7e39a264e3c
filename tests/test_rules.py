from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stationlens.functions import rules
from stationlens.functions.rules import RuleConfig, py_priority, py_risk, py_trend
from stationlens.streaming.machines import AlertMachine, Episode, acknowledged
from tests.station_data import SOURCE, state

CFG = RuleConfig()


@pytest.mark.parametrize(
    "risk,duration,p95,trend,score",
    [("EMPTY", 300, 8, 100, 92.0), ("EMPTY", 300, 0, 100, 72.0), ("FULL", 300, 8, 100, 92.0), ("OFFLINE", 300, 0, 0, 58.0), ("STALE", 300, 0, 0, 50.0), ("EMPTY", 600, 8, 100, 100.0)],
)
def test_scores(spark, risk, duration, p95, trend, score):
    assert py_priority(risk, duration, {"found": p95 > 0, "p95_pickups": p95, "p95_dropoffs": p95}, trend, CFG)["score"] == score
    column = rules.priority(F.lit(risk), F.lit(float(duration)), F.lit(p95 > 0), F.lit(p95), F.lit(p95), F.lit(float(trend)), CFG)
    assert spark.range(1).select(column["score"]).first()[0] == score


def test_linear_persistence():
    assert py_priority("EMPTY", 300, {}, 0, RuleConfig(persistence_form="linear"))["score"] == 62.0


def test_precedence():
    calm = state("a", 0)
    assert py_risk(calm, CFG) == "BALANCED"
    assert py_risk(state("a", 0, 0, 10), CFG) == "EMPTY" and py_risk(state("a", 0, 10, 0), CFG) == "FULL" and py_risk(state("a", 0, 0, 0), CFG) == "DATA_QUALITY"
    assert py_risk(state("a", 0, 2, 10), CFG) == "LOW_BIKES" and py_risk(state("a", 0, 10, 1), CFG) == "LOW_DOCKS"
    assert py_risk(state("a", 0, 0, 10, renting=False), CFG) == "OFFLINE" and py_risk(state("a", 0, 0, 10, age=181, renting=False), CFG) == "STALE"
    assert py_risk(calm | {"quality": {"timestamp_status": "SENTINEL", "issue_codes": []}}, CFG) == "DATA_QUALITY"


def test_columns_agree_with_python(spark):
    cases = [(b, d, age, ok, pb, pd) for b in (0, 1, 2, 3, 12) for d in (0, 1, 2, 3, 12) for age in (None, 5, 181) for ok in (True, False) for pb, pd in ((None, None), (7, 3))]
    df = spark.createDataFrame(cases, "bikes int, docks int, age int, ok boolean, pb int, pd int")
    risk = rules.risk(F.col("bikes"), F.col("docks"), stale=rules.is_stale(F.col("age"), None, CFG), offline=~F.col("ok"), doubtful=F.lit(False), cfg=CFG)
    got = df.withColumn("risk", risk).withColumn("trend", rules.onset_trend(F.col("risk"), F.col("pb"), F.col("pd"), F.col("bikes"), F.col("docks"))).collect()
    for r in got:
        want = py_risk(state("a", 0, r.bikes, r.docks, age=r.age, renting=r.ok), CFG)
        assert r.risk == want and r.trend == pytest.approx(py_trend(want, None if r.pb is None else (r.pb, r.pd), (r.bikes, r.docks)), abs=0.011)


def test_config_is_checked():
    with pytest.raises(ValueError):
        RuleConfig(weights={"severity": 1.0})
    with pytest.raises(ValueError):
        RuleConfig(weights=dict.fromkeys(CFG.weights, 0.3))
    with pytest.raises(ValueError):
        RuleConfig(persistence_seconds=0)


def feed(moves: list[tuple[int, int, int]], cfg: RuleConfig = CFG) -> list[dict]:
    machine, e, out = AlertMachine(cfg, SOURCE), Episode(), []
    for k, (minute, bikes, docks) in enumerate(moves):
        out += machine.step(e, "s", state("s", minute, bikes, docks), 60_000 * minute, 0, k)
    return out


def test_machine_opens_updates_and_resolves():
    events = feed([(0, 10, 10), (1, 0, 20), (3, 0, 20), (6, 0, 20), (6, 9, 9), (11, 0, 20), (12, 10, 10)])
    assert [e["event_type"] for e in events] == ["ALERT_OPENED", "ALERT_UPDATED", "ALERT_RESOLVED"]
    opened, updated, resolved = events
    assert opened["alert_id"] == updated["alert_id"] == resolved["alert_id"]
    assert resolved["priority"]["score"] == 0 and resolved["recommended_action"] == "NONE" and resolved["alert_type"] == "EMPTY"
    ack = acknowledged(opened, "2026-04-06T12:06:00Z")
    assert ack["lifecycle_status"] == "ACKNOWLEDGED" and ack["alert_event_id"] != opened["alert_event_id"]
    with pytest.raises(ValueError):
        acknowledged(resolved, "2026-04-06T12:06:00Z")


steps = st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0, 1, 5, 12]), st.sampled_from([0, 1, 5, 12])), max_size=30)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(steps)
def test_machine_invariants(moves):
    minute, timed = 0, []
    for gap, b, d in moves:
        minute += gap
        timed.append((minute, b, d))
    events = feed(timed)
    repeated = feed([m for m in timed for _ in (0, 1)])  # a repeated state changes nothing
    assert [e["alert_event_id"] for e in events] == [e["alert_event_id"] for e in repeated]
    opened = [e for e in events if e["event_type"] == "ALERT_OPENED"]
    assert len({e["alert_id"] for e in opened}) == len(opened)
    for e in events:
        if e["event_type"] == "ALERT_RESOLVED":
            mine = [o for o in opened if o["alert_id"] == e["alert_id"]]
            assert len(mine) == 1 and mine[0]["time"]["status_changed_at_utc"] < e["time"]["status_changed_at_utc"]
    assert len([e for e in events if e["event_type"] == "ALERT_RESOLVED"]) == len({e["alert_id"] for e in events if e["event_type"] == "ALERT_RESOLVED"})
