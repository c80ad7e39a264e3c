"""Feed polling: HTTP documents as a Spark source, with bounded retries."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stationlens.functions.contracts import publication_errors
from stationlens.operators.observations import feed_endpoints, normalize_snapshot
from stationlens.sources.sinks import archive, write_json

DOCUMENT = "url string, value string, snapshot_sha256 string, observed_at timestamp"


def fetch(url: str, attempts: int = 4, first_wait: float = 0.5, longest_wait: float = 8.0, timeout: float = 10.0, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """A document, waiting twice as long after each failure. Client errors other than 408 and 429 are final."""
    for k in range(attempts):
        try:
            with opener(url, timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code not in (408, 429) or k == attempts - 1:
                raise
        except (urllib.error.URLError, TimeoutError):
            if k == attempts - 1:
                raise
        sleep(min(longest_wait, first_wait * 2**k))
    raise ValueError("attempts must be at least 1")


class _Url(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], attempts: int) -> None:
        self.urls, self.attempts = urls, attempts

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        content = fetch(partition.value, self.attempts)
        yield partition.value, content.decode("utf-8"), hashlib.sha256(content).hexdigest(), datetime.now(UTC)


class FeedSource(DataSource):
    """``spark.read.format("station_feed").option("urls", "a,b").load()``: a row a document, a task a URL."""

    @classmethod
    def name(cls) -> str:
        return "station_feed"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader([u.strip() for u in self.options["urls"].split(",") if u.strip()], int(self.options.get("attempts", "4")))


def new_snapshots(documents: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Each document once by its hash, without those seen before."""
    first = documents.withColumn("_turn", F.row_number().over(Window.partitionBy("snapshot_sha256").orderBy("observed_at"))).filter("_turn = 1").drop("_turn")
    return first if seen is None else first.join(seen.select("snapshot_sha256"), "snapshot_sha256", "left_anti")


@dataclass(frozen=True)
class PollConfig:
    """How a feed is polled; the times are seconds."""

    discovery_url: str
    source_system: str
    archive_root: str
    language: str = "en"
    stale_after: int = 180
    metadata_refresh: int = 3600
    least_wait: float = 30.0
    failure_wait: float = 1.0
    longest_failure_wait: float = 15.0
    attempts: int = 4


class Poller:
    """Polls a feed: fetch, archive, skip what was published before, refresh the metadata when due, normalise, validate, publish.

    ``publish`` gets (valid observations, invalid ones with ``errors``) of a snapshot. What was published last is kept in a file,
    so that a restart does not publish it again. ``log`` holds a row a poll, for ``poll_counters``.
    """

    LOG = "poll_id bigint, started_at timestamp, outcome string, snapshot_sha256 string, snapshot_at timestamp, stale boolean, retries bigint, metadata_refreshed bigint, events_normalized bigint, events_published bigint, invalid_events bigint, duration_ms bigint, error string"

    def __init__(self, spark: SparkSession, cfg: PollConfig, publish: Callable[[DataFrame, DataFrame], None], state_path: str, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> None:
        self.spark, self.cfg, self.publish, self.state_path = spark, cfg, publish, Path(state_path)
        self.opener, self.sleep, self.now = opener, sleep, now
        self.endpoints: dict[str, str] | None = None
        self.information: bytes | None = None
        self.refreshed: datetime | None = None
        self.log: list[tuple] = []

    def _get(self, url: str) -> bytes:
        def counted(wait: float) -> None:
            self.retries += 1
            self.sleep(wait)

        return fetch(url, self.cfg.attempts, opener=self.opener, sleep=counted)

    def _text(self, content: bytes) -> DataFrame:
        return self.spark.createDataFrame([(content.decode("utf-8"),)], "value string")

    def once(self) -> float:
        """One poll; the seconds until the next. A failure is logged and raised."""
        at, began, self.retries, refreshed = self.now(), time.perf_counter(), 0, 0
        row = {"snapshot_sha256": None, "snapshot_at": None, "stale": False, "events_normalized": 0, "events_published": 0, "invalid_events": 0}

        def note(outcome: str, error: str | None = None) -> None:
            took = int((time.perf_counter() - began) * 1000)
            self.log.append((len(self.log), at, outcome, row["snapshot_sha256"], row["snapshot_at"], row["stale"], self.retries, refreshed, row["events_normalized"], row["events_published"], row["invalid_events"], took, error))

        try:
            if self.endpoints is None:
                self.endpoints = {r["name"]: r["url"] for r in feed_endpoints(self._text(self._get(self.cfg.discovery_url)), self.cfg.language).collect()}
            content = self._get(self.endpoints["station_status"])
            document = json.loads(content)
            snapshot, ttl = datetime.fromtimestamp(int(document["last_updated"]), UTC), int(document.get("ttl", 60))
            digest = hashlib.sha256(content).hexdigest()
            path, _ = archive(self.cfg.archive_root, "station_status", content, snapshot)
            row |= {"snapshot_sha256": digest, "snapshot_at": snapshot, "stale": (at - snapshot).total_seconds() > self.cfg.stale_after}
            wait = max(self.cfg.least_wait, float(ttl))
            if self.state_path.exists() and json.loads(self.state_path.read_text())["snapshot_sha256"] == digest:
                note("DUPLICATE")
                return wait
            if self.information is None or (at - self.refreshed).total_seconds() >= self.cfg.metadata_refresh:
                self.information = self._get(self.endpoints["station_information"])
                archive(self.cfg.archive_root, "station_information", self.information, at)
                self.refreshed, refreshed = at, 1
            status = self.spark.createDataFrame([(content.decode("utf-8"), at, digest, str(document.get("version")), ttl, str(path))], "value string, observed_at timestamp, snapshot_sha256 string, feed_version string, feed_ttl_seconds bigint, raw_archive_path string")
            made = normalize_snapshot(status, self._text(self.information), self.cfg.source_system, self.cfg.stale_after)
            checked = made.select(F.struct("*").alias("o"), publication_errors(F.struct("*"), self.cfg.source_system).alias("errors")).persist()
            valid, invalid = checked.filter(F.size("errors") == 0).select("o.*"), checked.filter(F.size("errors") > 0).select("o.*", "errors")
            self.publish(valid, invalid)
            row |= {"events_normalized": checked.count(), "events_published": valid.count(), "invalid_events": invalid.count()}
            checked.unpersist()
            write_json(self.state_path, {"snapshot_sha256": digest, "published_at": at.isoformat(), "raw_archive_path": str(path)})
            note("PUBLISHED")
            return wait
        except Exception as e:
            note("FAILED", f"{type(e).__name__}: {e}")
            raise

    def run(self, polls: int | None = None) -> None:
        """Polls for ever or so many times; after failures it waits longer each time and asks for the endpoints anew."""
        failures, k = 0, 0
        while polls is None or k < polls:
            try:
                wait, failures = self.once(), 0
            except Exception:  # noqa: BLE001  logged
                failures += 1
                wait, self.endpoints = min(self.cfg.longest_failure_wait, self.cfg.failure_wait * 2 ** (failures - 1)), None
            k += 1
            if polls is None or k < polls:
                self.sleep(wait)

    def log_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, self.LOG)
