"""Serving merges, profiles, and the plans that scale depends on."""

from __future__ import annotations

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from stationlens.operators import quality as qa
from stationlens.operators import serving as sv
from stationlens.operators.observations import latest_state, with_baseline
from stationlens.plans import catalog
from stationlens.plans.standin import load, observations

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def folded(statuses_and_times):
    """The merge one event at a time."""
    state = None
    for status, at in statuses_and_times:
        if state and at < state[1]:
            continue
        if state is None:
            state = (status, at)
        elif status == "RESOLVED" or state[0] == "RESOLVED":
            state = ("RESOLVED", at)
        elif state[0] == "ACKNOWLEDGED" and status == "OPEN":
            state = ("ACKNOWLEDGED", at)
        else:
            state = (status, at)
    return state


def test_lifecycle_merge_equals_the_fold(spark):
    cases = list(itertools.product(itertools.product(("OPEN", "ACKNOWLEDGED", "RESOLVED"), repeat=3), itertools.permutations((1, 2, 3)))) + [((a, b, b), (1, 1, 1)) for a in ("OPEN", "RESOLVED") for b in ("OPEN", "ACKNOWLEDGED")]
    rows = [(str(k), str(i), "s", "EMPTY", s, "CRITICAL", float(i), t, t, t if s == "RESOLVED" else None, i) for k, (ss, ts) in enumerate(cases) for i, (s, t) in enumerate(zip(ss, ts, strict=True))]
    events = spark.createDataFrame(rows, "alert_id string, alert_event_id string, station_id string, alert_type string, lifecycle_status string, severity string, priority_score double, detected_at int, status_changed_at int, resolved_at int, arrival int")
    got = {int(r.alert_id): (r.lifecycle_status, r.status_changed_at) for r in sv.merge_alert_state(events).collect()}
    assert got == {k: folded(zip(*c, strict=True)) for k, c in enumerate(cases)}


def test_pages_are_bounded(spark):
    state = spark.createDataFrame([("a", 1.0, 1, "OPEN")], "alert_id string, priority_score double, detected_at int, lifecycle_status string")
    assert sv.alert_page(state).count() == 1
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            sv.alert_page(state, limit=limit, offset=offset)


def test_nearest_rank_and_interpolation(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,)], "s double")
    r = qa.latency_summary(df, "s", F.lit(True)).first()
    assert (r.p50, r.p95) == (20.0, 40.0)
    p = qa.duration_profile(df, "s").first()
    assert (p.p50, p.p95) == (25.0, 38.5)
    assert qa.latency_summary(df.limit(0), "s", F.lit(True)).first().requests == 0


def test_metric_text(spark):
    lines = spark.createDataFrame([("up 1",), ('req{route="a\\"b"} 2.5',), ("# HELP up x",)], "line string")
    assert [r.value for r in qa.read_metric(lines, "req").collect()] == [2.5]
    h = spark.createDataFrame([('a"b\n', "0.1", 3)], "route string, le string, bucket_count long")
    assert qa.exposition(h, "m", "route").first().line == 'm_bucket{route="a\\"b\\n",le="0.1"} 3'


def test_fingerprint_does_not_depend_on_order(spark):
    df = load(spark, SF, "events")
    a, b = (qa.state_fingerprint(x, ["event_id", "value"]).first().fingerprint for x in (df, df.repartition(7).orderBy(F.desc("event_id"))))
    assert a == b != qa.state_fingerprint(df.filter("event_id <> 5"), ["event_id", "value"]).first().fingerprint


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 11])
def test_ordered_fingerprint_has_two_levels_whatever_the_rows(spark, n):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    names = [f"{k:02}" for k in range(n)]
    df = spark.createDataFrame([(x,) for x in reversed(names)], "k string").repartition(3)
    leaves = [sha(f"{t}|{x}") for t in ("a", "b") for x in names]
    want = sha("\n".join(sha("\n".join(leaves[i : i + 2])) for i in range(0, len(leaves), 2))) if n else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # the hashes come in several batches
    got = qa.ordered_fingerprint({"b": (df, ["k"]), "a": (df, ["k"])}, group=2).first()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (got.a_rows, got.b_rows, got.fingerprint) == (n, n, want)


def test_progress(spark):
    rows = ['{"batchId":0,"numInputRows":3,"eventTime":{"watermark":"a"},"stateOperators":[{"numRowsDroppedByWatermark":1},{"numRowsDroppedByWatermark":1}]}', '{"batchId":1,"numInputRows":2,"eventTime":{"watermark":"b"}}']
    r = qa.progress_summary(spark.createDataFrame([(x,) for x in rows], "value string")).first()
    assert (r.batches, r.input_rows, r.late_rows, r.watermarks) == (2, 5, 2, 2)


def test_plans(spark):
    # a filter and the columns reach the scan
    text = plan(load(spark, SF, "events").filter("value > 100").select("event_id"))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)]" in text and "ReadSchema: struct<event_id:bigint,value:double>" in text
    # one row a key is cut before the shuffle
    assert "WindowGroupLimit" in plan(latest_state(observations(spark, SF)))
    # a page is a bounded top-k, not a global sort
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["topk_pairs"](spark, SF))
    # a small baseline is broadcast by the size that its stage turned out to have; a large one is joined by a shuffle
    base = spark.createDataFrame([("1", 1, 1, 1, *[1.0] * 6)], "station_id string, iso_weekday int, local_hour int, calendar_days int, " + ", ".join(f"{s}_{d} double" for d in ("pickups", "dropoffs") for s in ("avg", "p50", "p95")))
    joined = with_baseline(observations(spark, SF), base)
    joined.collect()
    assert "BroadcastHashJoin" in plan(joined)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    joined = with_baseline(observations(spark, SF), base)
    joined.collect()
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan(joined)
    assert "Python" not in plan(catalog.QUERIES["risk_episodes"](spark, SF))


def test_every_query_is_registered_once():
    assert len(catalog.QUERIES) >= 55 and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
