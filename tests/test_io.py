from __future__ import annotations

import contextlib
import io
import json
import threading
import urllib.error
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from stationlens import cli
from stationlens.operators import quality
from stationlens.sources import feed, sinks
from stationlens.sources.store import Store
from tests.station_data import NOON, SOURCE, put_files, state


@pytest.fixture
def server():
    asked = {"n": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked["n"] += 1
            code = 503 if self.path == "/flaky" and asked["n"] < 3 else 404 if self.path == "/none" else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b'{"data": 1}')

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_fetch_retries(server):
    url, asked = server
    waits = []
    assert feed.fetch(f"{url}/flaky", sleep=waits.append) == b'{"data": 1}' and waits == [0.5, 1.0]
    asked["n"] = 0
    with pytest.raises(urllib.error.HTTPError):
        feed.fetch(f"{url}/none", sleep=waits.append)
    assert asked["n"] == 1


def test_feed_source(spark, server):
    from stationlens.session import ship

    ship(spark)
    spark.dataSource.register(feed.FeedSource)
    docs = spark.read.format("station_feed").option("urls", f"{server[0]}/a,{server[0]}/b").load()
    rows = docs.collect()
    assert {r.value for r in rows} == {'{"data": 1}'} and len(rows) == 2
    frame = spark.createDataFrame(rows, docs.schema)
    assert feed.new_snapshots(frame).count() == 1 and feed.new_snapshots(frame, frame).count() == 0


def test_sinks(spark, tmp_path):
    assert sinks.safe_output(str(tmp_path / "a"), [str(tmp_path)]) == tmp_path / "a"
    for bad in (tmp_path, tmp_path / ".." / "x"):
        with pytest.raises(ValueError):
            sinks.safe_output(str(bad), [str(tmp_path)])
    sinks.write_json(tmp_path / "d" / "x.json", {"a": 1})
    assert json.loads((tmp_path / "d" / "x.json").read_text()) == {"a": 1} and len(list((tmp_path / "d").iterdir())) == 1
    path, new = sinks.archive(tmp_path, "station_status", b"x", NOON)
    assert new and path.parent.name == "date=2026-05-13" and not sinks.archive(tmp_path, "station_status", b"x", NOON)[1]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("started_at,ended_at,start_station_id,end_station_id\n2026-04-01 08:00:00,2026-04-01 08:10:00,1,2\n")
    cli.main(["trips", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")])
    assert json.loads((tmp_path / "out" / "summary.json").read_text())["demand_events"] == 2
    put_files(str(tmp_path / "states"), [[state("a", 0, 0, 9)], [state("a", 6, 0, 9)]])
    cli.main(["alerts", "--input", str(tmp_path / "states"), "--output", str(tmp_path / "alerts"), "--checkpoints", str(tmp_path / "cp"), "--source-system", SOURCE])
    cli.main(["queue", "--output", str(tmp_path / "alerts"), "--to", str(tmp_path / "queue")])
    assert spark.read.json(str(tmp_path / "queue")).first().queue_rank == 1


def station_feed(bikes: int, updated: datetime) -> dict[str, dict]:
    """The three documents of a feed with two stations, one of them with a count that no station can have."""
    row = lambda name, n: {"station_id": name, "num_bikes_available": n, "num_bikes_disabled": 0, "num_docks_available": 10 - n, "num_docks_disabled": 0, "is_installed": 1, "is_renting": 1, "is_returning": 1, "last_reported": int(updated.timestamp()) - 9}
    return {
        "/start": {"data": {"en": {"feeds": [{"name": n, "url": f"http://feed/{n}"} for n in ("station_status", "station_information")]}}},
        "/station_status": {"last_updated": int(updated.timestamp()), "ttl": 45, "version": "2.3", "data": {"stations": [row("a", bikes), row("b", -1)]}},
        "/station_information": {"last_updated": 1, "data": {"stations": [{"station_id": "a", "short_name": "a.1", "name": "A", "lat": 1.0, "lon": 2.0, "capacity": 10}]}},
    }


def test_poll_cycle(spark, tmp_path):
    clock, served, sent, asked, waits = {"now": NOON}, {"docs": station_feed(4, NOON - timedelta(seconds=20))}, [], [], []

    @contextlib.contextmanager
    def opener(url, timeout):
        asked.append(url.rsplit("/", 1)[1])
        if served["docs"] is None:
            raise urllib.error.HTTPError(url, 404, "gone", {}, None)
        yield io.BytesIO(json.dumps(served["docs"]["/" + asked[-1]]).encode())

    def publish(valid, invalid):
        sent.append(({r.station.station_id for r in valid.collect()}, {r.station.station_id: r.errors for r in invalid.collect()}))

    def sleep(seconds):
        waits.append(seconds)
        clock["now"] += timedelta(seconds=seconds)

    cfg = feed.PollConfig("http://feed/start", SOURCE, str(tmp_path / "raw"), metadata_refresh=100)
    poller = lambda: feed.Poller(spark, cfg, publish, str(tmp_path / "state.json"), opener, sleep, lambda: clock["now"])
    p = poller()
    p.run(2)  # the second time the same snapshot
    assert sent == [({"a"}, {"b": ["availability.bikes_available"]})] and waits == [45.0]
    assert asked == ["start", "station_status", "station_information", "station_status"]
    served["docs"], clock["now"] = station_feed(5, NOON - timedelta(seconds=400)), NOON + timedelta(seconds=120)
    assert p.once() == 45.0  # stale, and time for the metadata again
    served["docs"] = None
    p.run(2)
    assert waits[-1] == 1.0 and p.endpoints is None
    got = quality.poll_counters(p.log_table()).first()
    assert (got.poll_attempts_total, got.poll_success_total, got.poll_failures_total, got.snapshots_published_total, got.duplicate_snapshots_total, got.stale_snapshots_total, got.metadata_refresh_total) == (5, 3, 2, 2, 1, 1, 2)
    assert (got.events_normalized_total, got.events_published_total, got.invalid_events_total) == (4, 2, 2) and got.last_error.startswith("HTTPError")
    assert len(list((tmp_path / "raw").rglob("*.json"))) == 4
    served["docs"] = station_feed(5, NOON - timedelta(seconds=400))
    again = poller()  # a restart knows what was published last
    again.once()
    assert again.log[0][2] == "DUPLICATE" and len(sent) == 2


def test_commands_of_the_stored_tables(spark, tmp_path, capsys):
    put_files(str(tmp_path / "states"), [[state("a", 0, 0, 9)], [state("a", 6, 0, 9)]])
    cli.main(["alerts", "--input", str(tmp_path / "states"), "--output", str(tmp_path / "out"), "--checkpoints", str(tmp_path / "cp"), "--source-system", SOURCE])
    cli.main(["finish", "--output", str(tmp_path / "out")])
    assert json.loads(capsys.readouterr().out) == {"priority_queue": 1}
    cli.main(["materialize", "--store", str(tmp_path / "store"), "--alerts", str(tmp_path / "out" / "alerts"), "--current", str(tmp_path / "states")])
    assert json.loads(capsys.readouterr().out)["alert_inserted"] == 1
    alert = Store(spark, str(tmp_path / "store")).read("alert_state").first().alert_id
    cli.main(["acknowledge", "--store", str(tmp_path / "store"), "--alert", alert, "--key", "a-long-key", "--by", "me", "--batch", "0"])
    assert capsys.readouterr().out.strip() == "ACCEPTED"
    with pytest.raises(ValueError):
        cli.main(["acknowledge", "--store", str(tmp_path / "store"), "--alert", alert, "--key", "short", "--by", "me", "--batch", "1"])
