from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stationlens.functions.contracts import ALERT, alert_errors, dead_letters, parse_observations
from stationlens.functions.rules import RuleConfig
from stationlens.operators import episodes as ep
from stationlens.operators.observations import feed_endpoints, normalize_snapshot
from stationlens.operators.materialize import acknowledge_alerts, materialize_files, materialize_stream
from stationlens.operators.serving import acknowledge, alert_documents, health, one_row, priority_queue
from stationlens.sources.store import Store
from stationlens.sources.streams import expected_records, file_records, json_lines, rows, topic_spans
from stationlens.streaming import jobs
from stationlens.streaming.processors import ALERTS
from tests.station_data import SOURCE, observation, put_files, state


def some_baseline(spark):
    """The demand at station y on Wednesdays at 8 local time."""
    stats = ", ".join(f"{s}_{d} double" for d in ("pickups", "dropoffs") for s in ("avg", "p50", "p95"))
    return spark.createDataFrame([("y.1", 3, 8, 4, 1.0, 1.0, 6.0, 1.0, 1.0, 2.0)], f"station_id string, iso_weekday int, local_hour int, calendar_days int, {stats}")


def test_observation_job(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "checkpoints"))
    first = [
        [observation("y", 0, 7)],
        [observation("y", 4, 6), observation("x", 1, 2)],
        ["[1, 2"],
        [observation("x", 9, 1), observation("x", 1, 2)],  # the second is a copy
        [observation("x", 7, 1)],  # older than the state, in time for its window
        [observation("z", 2, 4, -3)],
        [observation("y", 30, 7)],  # from here on windows up to minute 20 are closed
        [observation("y", 33, 3)],
        [observation("x", 3, 8)],  # too late
    ]
    put_files(src, first)

    def run():
        jobs.finish(jobs.station_job(file_records(spark, src), some_baseline(spark), jobs.file_sink(out, cp)))

    run()
    put_files(src, [[observation("z", 50, 4)]], start=len(first))
    run()
    letters = spark.read.option("recursiveFileLookup", "true").json(f"{out}/dead_letters")
    assert sorted((r.error_codes, r.record_key == r.raw_sha256) for r in letters.collect()) == [(["AVAILABILITY_INVALID"], False), (["MALFORMED_JSON"], True)]
    states = jobs.read_output(spark, f"{out}/current_state", "station_id string, event_id string, event_time timestamp, current_state_json string, input_partition bigint")
    accepted = sorted((r.station_id, r.event_time.minute) for r in states.collect())
    assert accepted == [("x", 1), ("x", 9), ("y", 0), ("y", 4), ("y", 30), ("y", 33), ("z", 50)]
    assert {r.station_id: json.loads(r.current_state_json)["historical_demand"]["found"] for r in jobs.current_snapshot(spark, out).collect()} == {"x": False, "y": True, "z": False}
    assert states.groupBy("station_id").agg(F.count_distinct("input_partition").alias("n")).filter("n <> 1").count() == 0
    windows = spark.read.option("recursiveFileLookup", "true").json(f"{out}/windows").orderBy("station_id", "window_start")
    assert [(r.station_id, r.observation_count) for r in windows.collect()] == [("x", 1), ("x", 2), ("y", 2), ("y", 2)]
    before = states.count()
    run()  # no input: nothing new
    assert jobs.read_output(spark, f"{out}/current_state", "event_id string").count() == before
    assert jobs.materialize_outputs(spark, out) == {"current_snapshot": 3}
    assert spark.read.json(f"{out}/current_snapshot").count() == 3


def test_messages_and_the_memory_sink(spark, tmp_path):
    src = str(tmp_path / "in")
    put_files(src, [[observation("x", 0, 7)], ["{"], [observation("x", 30, 7)], [observation("x", 31, 7)]])
    jobs.finish(jobs.station_job(file_records(spark, src), some_baseline(spark), jobs.memory_sink("shown")))
    table = lambda name: {(r.key, json.loads(r.value).get("event_id")) for r in spark.table(f"shown_{name}").collect()}
    assert {k for k, _ in table("current_state")} == {"x"} and len(table("current_state")) == 3
    assert {k for k, _ in table("windows")} == {"x|2026-05-13T12:05:00Z"}
    assert len(next(iter(table("dead_letters")))[0]) == 64


#: What becomes of a station with 10 bikes and 10 docks, and how much demand it knows.
TROUBLES = {
    "busy": ({"bikes": 0, "docks": 20}, 8),
    "calm": ({"bikes": 0, "docks": 20}, 0),
    "brimful": ({"bikes": 20, "docks": 0}, 8),
    "growing": ({"bikes": 0, "docks": 20}, 8),
    "shut": ({"renting": False}, 0),
    "silent": ({"age": 999}, 0),
}


def troubled(name, minute):
    change, p95 = TROUBLES[name]
    return state(name, minute, **({"bikes": 10, "docks": 10} | change), p95=p95)


def well(name, minute):
    return state(name, minute, 10, 10, p95=TROUBLES[name][1])


def test_alert_job(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "checkpoints"))
    put_files(src, [
        [well(n, -2) for n in TROUBLES],
        [troubled(n, 1) for n in TROUBLES],
        ["no record"],
        [troubled(n, 7) for n in reversed(TROUBLES)],
        [troubled("calm", 4), troubled("brimful", 7)],  # older than the state; a copy
    ])

    def run(to=out, checkpoints=cp):
        jobs.finish(jobs.alert_job(file_records(spark, src), jobs.file_sink(to, checkpoints), RuleConfig(), SOURCE))

    run()
    put_files(src, [[well("busy", 16), troubled("growing", 15)]], start=5)
    run()
    events = jobs.read_output(spark, f"{out}/alerts", ALERTS).cache()
    scores = {(r.station_id, r.event_type): r.priority_score for r in events.collect()}
    opened = {"busy": 93.6, "calm": 73.6, "brimful": 93.6, "growing": 93.6, "shut": 59.6, "silent": 51.6}
    assert scores == {(n, "ALERT_OPENED"): x for n, x in opened.items()} | {("growing", "ALERT_UPDATED"): 100.0, ("busy", "ALERT_RESOLVED"): 0.0}
    queue = jobs.queue_snapshot(spark, out).orderBy("queue_rank").collect()
    assert [r.station_id for r in queue] == ["growing", "brimful", "calm", "shut", "silent"]
    bad = events.select(F.from_json("alert_json", ALERT).alias("a")).filter(F.size(alert_errors(F.col("a"))) > 0)
    assert bad.count() == 0
    assert spark.read.option("recursiveFileLookup", "true").json(f"{out}/dead_letters").count() == 1
    # acknowledging: once, and only what is active
    calm, busy = (events.filter(f"station_id = '{n}'").first().alert_id for n in ("calm", "busy"))
    commands = spark.createDataFrame([(calm, "2026-05-13 12:20:00"), (busy, "2026-05-13 12:30:00")], "alert_id string, at string").select("alert_id", F.col("at").cast("timestamp").alias("acknowledged_at"))
    made, refused = acknowledge(events, commands)
    assert [r.alert_id for r in made.collect()] == [calm] and [r.alert_id for r in refused.collect()] == [busy]
    assert acknowledge(events.unionByName(made), commands)[0].count() == 0
    assert priority_queue(events.unionByName(made)).count() == 5
    # a clean replay gives the same identities, and so does the batch machine
    run(str(tmp_path / "again"), str(tmp_path / "checkpoints2"))
    ids = {r.alert_event_id for r in events.collect()}
    assert {r.alert_event_id for r in jobs.read_output(spark, str(tmp_path / "again/alerts"), ALERTS).collect()} == ids
    parsed = jobs.parse_current_states(file_records(spark, src, stream=False))
    flat = parsed.filter("is_valid").select(F.col("record.station_id").alias("station_id"), F.col("record.event_id").alias("event_id"), "event_time", "input_offset", F.col("raw_value").alias("current_state_json"))
    assert {r.alert_event_id for r in ep.replay(flat, RuleConfig(), SOURCE).collect()} == ids
    events.unpersist()
    # commands from a file, after the run
    (tmp_path / "commands.jsonl").write_text(json.dumps({"alert_id": calm, "acknowledged_at_utc": "2026-05-13T12:20:00Z"}) + "\n\n")
    from_file = jobs.acknowledge_commands(spark, str(tmp_path / "commands.jsonl"))
    assert jobs.materialize_outputs(spark, out, from_file) == {"acknowledged": 1, "priority_queue": 5}
    assert jobs.materialize_outputs(spark, out, from_file)["acknowledged"] == 0
    kept = jobs.read_output(spark, f"{out}/alerts", ALERTS).filter("event_type = 'ALERT_ACKNOWLEDGED'").first()
    document = json.loads(kept.alert_json)
    assert document["lifecycle_status"] == "ACKNOWLEDGED" and document["alert_event_id"] == kept.alert_event_id and document["time"]["status_changed_at_utc"] == "2026-05-13T12:20:00Z"
    with pytest.raises(ValueError):
        jobs.apply_acknowledgements(spark, out, commands)
    # into the stored tables, from files and as a topic
    store = Store(spark, str(tmp_path / "store"))
    done = materialize_files(spark, store, 0, alerts=f"{out}/alerts", current=src_states(tmp_path))
    assert done == {"alert_read": 9, "alert_inserted": 9, "current_read": 3, "current_updated": 2, "invalid": 0}
    assert materialize_files(spark, store, 0, alerts=f"{out}/alerts")["alert_read"] == 0  # the batch was stored before
    assert materialize_files(spark, store, 1, alerts=f"{out}/alerts")["alert_inserted"] == 0  # the events were
    status = {r.station_id: r.lifecycle_status for r in store.read("alert_state").collect()}
    assert status == {"busy": "RESOLVED", "calm": "ACKNOWLEDGED", "brimful": "OPEN", "growing": "OPEN", "shut": "OPEN", "silent": "OPEN"}
    topic = str(tmp_path / "topic")
    put_files(topic, [[r.alert_json] for r in events.orderBy("event_time").collect()] + [["{"]])
    streamed, told = Store(spark, str(tmp_path / "streamed")), []
    for _ in range(2):
        materialize_stream(file_records(spark, topic, topic="alerts"), streamed, "alert", str(tmp_path / "checkpoints3"), on_batch=lambda k, done: told.append(done)).awaitTermination()
    assert sum(d["alert_inserted"] for d in told) == 8 and sum(d["invalid"] for d in told) == 1
    rows = lambda s: {r.alert_id: (r.priority_score, r.resolved_at) for r in s.read("alert_state").filter("acknowledged_at IS NULL").collect()}
    assert rows(streamed).items() >= rows(store).items()
    assert streamed.read("consumer_offsets").filter("topic = 'alerts'").count() > 0
    # acknowledging in the stored tables
    asks = [("key-0001", calm), ("key-0002", "unknown"), ("key-0003", busy), ("key-0004", next(r.alert_id for r in store.read("alert_state").collect() if r.station_id == "shut"))]
    requests = spark.createDataFrame([(k, a, "me", datetime(2026, 5, 13, 13)) for k, a in asks], "idempotency_key string, alert_id string, requested_by string, acknowledged_at timestamp")
    outcomes = {r.idempotency_key: r.outcome for r in acknowledge_alerts(store, "api", 0, requests).collect()}
    assert outcomes == {"key-0001": "ALREADY_ACKNOWLEDGED", "key-0002": "NOT_FOUND", "key-0003": "CONFLICT", "key-0004": "ACCEPTED"}
    after = store.read("alert_state").filter("station_id = 'shut'").first()
    assert (after.lifecycle_status, after.acknowledged_by) == ("ACKNOWLEDGED", "me") and store.read("alert_commands").count() == 1
    assert {r.outcome for r in acknowledge_alerts(store, "api", 1, requests.filter("idempotency_key = 'key-0004'")).collect()} == {"REPLAYED"}
    shown = one_row(alert_documents(store.read("alert_state")), "alert_id", after.alert_id)["document"]
    assert shown["acknowledgement"]["acknowledged_by"] == "me" and shown["priority"]["score"] == 59.6
    with pytest.raises(LookupError):
        one_row(store.read("alert_state"), "alert_id", "unknown")
    assert health(store.read("station_current"), store.read("alert_state")) == {"status": "ready", "stations": 2, "active_alerts": 5}


def src_states(tmp_path) -> str:
    """Two stations' states as a job writes them, the newest first."""
    folder = tmp_path / "states"
    put_files(str(folder), [[{"current_state_json": json.dumps(state("a", 3))}, state("b", 1)], [{"current_state_json": json.dumps(state("a", 2))}]])
    return str(folder)


def test_a_bad_line_is_named(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(state("a", 1)) + "\n\n{oops\n")
    with pytest.raises(ValueError, match=r"x\.json:3 is not JSON"):
        materialize_files(spark, Store(spark, str(tmp_path / "store")), 0, current=str(tmp_path / "x.json"))
    (tmp_path / "y.json").write_text(json.dumps(state("a", 1) | {"station_id": "b"}) + "\n")
    with pytest.raises(ValueError, match="STATION_ID_MISMATCH"):
        materialize_files(spark, Store(spark, str(tmp_path / "store")), 0, current=str(tmp_path / "y.json"))


def test_a_store_keeps_whole_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), keep=2)
    offsets = lambda n: spark.createDataFrame([("t", 0, n)], "topic string, partition bigint, next_offset bigint")
    assert store.read("consumer_offsets").count() == 0
    for n in range(5):
        assert store.commit({"consumer_offsets": ("replace", offsets(n))}, "x", n)
    assert not store.commit({"consumer_offsets": ("replace", offsets(99))}, "x", 4) and store.commit({"consumer_offsets": ("append", offsets(7))}, "y", 0)
    assert sorted(r.next_offset for r in store.read("consumer_offsets").collect()) == [4, 7]
    assert len(list((tmp_path / "s" / "data" / "consumer_offsets").iterdir())) == 2


def test_ordered_lines(spark, tmp_path):
    put_files(str(tmp_path / "in"), [["c", "a", "b"]])
    lines = spark.readStream.format("text").load(str(tmp_path / "in"))
    jobs.write_ordered(lines, str(tmp_path / "out"), str(tmp_path / "cp"), "value", "value").awaitTermination()
    files = sorted((tmp_path / "out" / "batch_id=0").glob("part-*"))
    assert [x for f in files for x in f.read_text().split()] == ["a", "b", "c"]


def test_spans_and_expected_records(spark):
    records = rows(spark, [("k", json.dumps(observation("a", m, 5)), "t", m % 2, 10 + m) for m in range(5)])
    assert {(r.partition, r.low, r.high, r.records) for r in topic_spans(records).collect()} == {(0, 10, 15, 5), (1, 11, 14, 3)}
    keyed = records.withColumn("key", F.lit("a"))
    assert expected_records(lambda: keyed, lambda r: parse_observations(r, SOURCE), 5).count() == 5
    with pytest.raises(RuntimeError):
        expected_records(lambda: keyed, lambda r: parse_observations(r, SOURCE), 6, attempts=2)
    with pytest.raises(ValueError, match="KAFKA_KEY"):
        expected_records(lambda: records, lambda r: parse_observations(r, SOURCE), 5)


def test_validation_codes(spark):
    wrong = {
        "SCHEMA_VERSION_INVALID": {"schema_version": "2"}, "EVENT_ID_INVALID": {"event_id": "xyz"}, "EVENT_TYPE_INVALID": {"event_type": None}, "SOURCE_SYSTEM_INVALID": {"source_system": "other"},
        "STATION_ID_MISSING": {"station": {"station_id": ""}}, "AVAILABILITY_INVALID": {"availability": None}, "SERVICE_FLAGS_INVALID": {"service": {"is_installed": True}}, "EVENT_TIME_INVALID": {"time": {"snapshot_updated_at_utc": "soon"}},
        "SOURCE_LINEAGE_INVALID": {"source": {"feed_version": "9"}}, "QUALITY_INVALID": {"quality": None},
    }
    records = [(None, json.dumps(observation("a", 0, 5, **change)), "t", 0, k) for k, change in enumerate(wrong.values())] + [("b", json.dumps(observation("a", 0, 5)), "t", 0, 90), (None, "{", "t", 0, 91), ("a", json.dumps(observation("a", 0, 5)), "t", 0, 92)]
    got = {r.input_offset: r.error_codes for r in parse_observations(rows(spark, records), SOURCE).collect()}
    assert [got[k] for k in range(len(wrong))] == [[c] for c in wrong]
    assert got[90] == ["KAFKA_KEY_STATION_MISMATCH"] and got[91] == ["MALFORMED_JSON"] and got[92] == []
    letter = dead_letters(parse_observations(rows(spark, [(None, "{" + "x" * 3000, "t", 0, 1)]))).first()
    assert len(letter.raw_fragment) == 1000 and letter.record_key == letter.raw_sha256


def test_feeds(spark):
    status = {"last_updated": 1_775_476_800, "ttl": 60, "version": "2.3", "data": {"stations": [{"station_id": k, "num_bikes_available": b, "num_bikes_disabled": 0, "num_docks_available": 10 - b, "num_docks_disabled": 0, "is_installed": 1, "is_renting": 1, "is_returning": 1, "last_reported": t} for k, b, t in (("a", 4, 1_775_476_790), ("b", 3, 86400), ("c", 2, None), ("d", 1, 1_775_400_000))]}}
    info = {"last_updated": 1, "data": {"stations": [{"station_id": k, "short_name": k, "name": k, "lat": 1.0, "lon": 2.0, "capacity": c} for k, c in (("a", 10), ("b", 12), ("c", 10))]}}
    s = spark.createDataFrame([(json.dumps(status), "2026-04-06 12:00:10", "f" * 64, "2.3")], "value string, at string, snapshot_sha256 string, feed_version string").withColumn("observed_at", F.col("at").cast("timestamp")).drop("at")
    got = {r.station.station_id: r for r in normalize_snapshot(s, spark.createDataFrame([(json.dumps(info),)], "value string"), SOURCE).collect()}
    assert {k: r.quality.timestamp_status for k, r in got.items()} == {"a": "VALID", "b": "SENTINEL", "c": "MISSING", "d": "VALID"}
    assert got["a"].quality.issue_codes == [] and got["a"].time.source_age_seconds == 20
    assert got["b"].quality.issue_codes == ["SOURCE_TIMESTAMP_SENTINEL", "CAPACITY_MISMATCH"] and got["d"].quality.issue_codes == ["SOURCE_STALE", "METADATA_UNMATCHED"]
    assert got["d"].station.metadata_match_status == "UNMATCHED" and all(len(r.event_id) == 64 for r in got.values())
    doc = {"data": {"fr": {"feeds": [{"name": "station_status", "url": "u"}]}}}
    assert [tuple(r) for r in feed_endpoints(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()] == [("station_status", "u")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"alert_json": json.dumps({"a": 1})}) + "\n" + json.dumps({"a": 2}) + "\n")
    got = json_lines(spark, str(tmp_path / "x.json"), "a int", wrapper="alert_json").collect()
    assert sorted(r.record.a for r in got) == [1, 2]
