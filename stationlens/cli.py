"""Command line: ``python -m stationlens.cli trips|stations|alerts|queue|finish|materialize|acknowledge|poll ...``."""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stationlens.functions.contracts import SOURCE_SYSTEM, request_errors
from stationlens.functions.rules import RuleConfig
from stationlens.operators import trips as tr
from stationlens.operators.materialize import acknowledge_alerts, materialize_files, materialize_stream
from stationlens.session import local_session
from stationlens.sources.feed import PollConfig, Poller
from stationlens.sources.sinks import safe_output, write_json
from stationlens.sources.store import Store
from stationlens.sources.streams import file_records, kafka_records
from stationlens.sources.trips import read_back, read_trips, read_zipped_trips, write_tables
from stationlens.streaming import jobs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stationlens")
    p.add_argument("--cores", default="*")
    commands = p.add_subparsers(dest="command", required=True)
    trips = commands.add_parser("trips", help="trip files to silver, quarantine, hourly and baseline tables")
    trips.add_argument("--input", required=True)
    trips.add_argument("--zipped", action="store_true", help="the CSV files are in ZIP archives")
    for name, text in (("stations", "observations to current states and windows"), ("alerts", "current states to alert events")):
        c = commands.add_parser(name, help=text)
        c.add_argument("--input", required=True, help="a folder of JSON lines, or kafka://servers/topic")
        c.add_argument("--checkpoints", required=True)
        c.add_argument("--source-system", default=SOURCE_SYSTEM)
        c.add_argument("--rules", help="a JSON file of thresholds and weights")
        c.add_argument("--publish", help="kafka://servers/prefix: topics prefix.output instead of files")
        if name == "stations":
            c.add_argument("--baseline", required=True)
    for c in list(commands.choices.values()):
        c.add_argument("--output", required=True)
        c.add_argument("--allow", action="append", help="folders that outputs may be written under; default: the output's parent")
    queue = commands.add_parser("queue", help="the priority queue of an alert job's output")
    queue.add_argument("--output", required=True)
    queue.add_argument("--to", required=True)
    last = commands.add_parser("finish", help="after a run: acknowledgements, current snapshot and queue of a job's output")
    last.add_argument("--output", required=True)
    last.add_argument("--commands", help="a file of acknowledge commands, JSON lines")
    store = commands.add_parser("materialize", help="files or topics of alerts and current states into the stored tables")
    store.add_argument("--store", required=True)
    store.add_argument("--alerts", help="a folder of JSON lines, or kafka://servers/topic")
    store.add_argument("--current", help="a folder of JSON lines, or kafka://servers/topic")
    store.add_argument("--batch", type=int, default=0, help="of files: a number that grows; one that was stored before changes nothing")
    store.add_argument("--checkpoints", help="of topics")
    acks = commands.add_parser("acknowledge", help="acknowledge an alert in the stored tables")
    for name in ("--store", "--alert", "--key", "--by"):
        acks.add_argument(name, required=True)
    acks.add_argument("--batch", type=int, required=True)
    acks.add_argument("--at", help="UTC time, ISO 8601; now if not given")
    poll = commands.add_parser("poll", help="poll a feed into files of observations")
    for name in ("--discovery", "--archive", "--to", "--state"):
        poll.add_argument(name, required=True)
    poll.add_argument("--source-system", default=SOURCE_SYSTEM)
    poll.add_argument("--polls", type=int)
    return p


def records(spark: SparkSession, source: str):
    if source.startswith("kafka://"):
        servers, _, topic = source.removeprefix("kafka://").partition("/")
        return kafka_records(spark, servers, topic)
    return file_records(spark, source)


def sink(args: argparse.Namespace, out: str) -> jobs.Sink:
    if not args.publish:
        return jobs.file_sink(out, args.checkpoints)
    servers, _, prefix = args.publish.removeprefix("kafka://").partition("/")
    return jobs.kafka_sink(servers, {name: f"{prefix}.{name.replace('_', '-')}" for name in jobs.KEYS}, args.checkpoints)


def materialize(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    store, topics = Store(spark, args.store), {k: p for k, p in (("alert", args.alerts), ("current", args.current)) if p and p.startswith("kafka://")}
    if not topics:
        return materialize_files(spark, store, args.batch, args.alerts, args.current)
    total: dict[str, int] = {}
    for kind, source in topics.items():  # one after the other: a store has one writer
        materialize_stream(records(spark, source), store, kind, f"{args.checkpoints}/{kind}", on_batch=lambda _, done: total.update({k: total.get(k, 0) + v for k, v in done.items()})).awaitTermination()
    return total


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = local_session(args.cores)
    if args.command == "queue":
        jobs.queue_snapshot(spark, args.output).write.mode("overwrite").json(args.to)
        return
    if args.command == "finish":
        print(json.dumps(jobs.materialize_outputs(spark, args.output, jobs.acknowledge_commands(spark, args.commands) if args.commands else None)))
        return
    if args.command == "materialize":
        print(json.dumps(materialize(spark, args)))
        return
    if args.command == "acknowledge":
        at = args.at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        request = spark.createDataFrame([(args.key, args.alert, args.by, at)], "idempotency_key string, alert_id string, requested_by string, acknowledged_at_utc string")
        wrong = request.select(request_errors(F.struct("*")).alias("e")).first()["e"]
        if wrong:
            raise ValueError(", ".join(wrong))
        made = request.withColumn("acknowledged_at", F.col("acknowledged_at_utc").cast("timestamp"))
        print(acknowledge_alerts(Store(spark, args.store), "commands", args.batch, made).first()["outcome"])
        return
    if args.command == "poll":
        def publish(valid, invalid):
            valid.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{args.to}/observations")
            if not invalid.isEmpty():
                invalid.write.mode("append").json(f"{args.to}/invalid")

        Poller(spark, PollConfig(args.discovery, args.source_system, args.archive), publish, args.state).run(args.polls)
        return
    out = str(safe_output(args.output, args.allow or [f"{args.output}/.."]))
    if args.command == "trips":
        raw = read_zipped_trips(spark, args.input) if args.zipped else read_trips(spark, args.input)
        write_tables(tr.trip_pipeline(raw), out)
        write_json(f"{out}/summary.json", tr.run_summary(tr.normalize(raw)).first().asDict() | {"rows_read_back": read_back(spark, out)})
        return
    cfg = RuleConfig()
    if args.rules:
        with open(args.rules, encoding="utf-8") as f:
            cfg = RuleConfig.load(f.read())
    if args.command == "stations":
        started = jobs.station_job(records(spark, args.input), spark.read.parquet(args.baseline), sink(args, out), cfg, args.source_system)
    else:
        started = jobs.alert_job(records(spark, args.input), sink(args, out), cfg, args.source_system)
    jobs.finish(started)


if __name__ == "__main__":
    main()
