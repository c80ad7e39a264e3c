"""Queries that return what SQL can't express, against brute force over the same records."""

from __future__ import annotations

import hashlib

from stationlens.plans import catalog

SF_DIR, UPDATES = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_all_dead_letters(spark):
    records = catalog._records(spark, SF_DIR)
    want = set()
    for r in records.collect():
        n = r.origin.offset
        if n % 19 == 0 or n % 7 == 0 or n % 11 == 0 or n % 13 == 0 or n % 17 == 0 or (n % 3 and n % 23 == 0):
            want.add((n, r.key if r.key is not None else hashlib.sha256(r.body.encode()).hexdigest()))
    got = catalog.QUERIES["dead_letter_all"](spark, SF_DIR).collect()
    assert {(r.input_offset, r.record_key) for r in got} == want and len(got) == len(want)
    assert any(n % 3 == 0 and n % 19 for n, _ in want)
    assert "dead_letter_all" not in catalog.ORACLE_SQL


def test_all_stream_alerts(spark):
    columns = ["station_id", "alert_id", "alert_event_id", "event_type", "event_time"]
    rows = lambda name: sorted(tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, UPDATES).collect())
    got = rows("stream_alerts_all")
    assert got == rows("alert_replay")
    assert [r for r in got if r[3] != "ALERT_UPDATED"] == rows("stream_alerts")
    assert any(r[3] == "ALERT_UPDATED" for r in got)
