"""Serving tables as files, changed by whole commits.

A commit is one small file that names the folders which make up every table from then on. It is created, never replaced, so
readers see all of a commit or none of it, and of two writers one fails. A commit also names the last batch of its source
that went in; a batch that is repeated changes nothing. Any file system that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from stationlens.session import delete
from stationlens.sources.sinks import LAYOUT, TABLES


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 3) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _path(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        where, fs = self._path("commits")
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def state(self) -> dict:
        """The newest commit: version, tables (name -> folders) and batches (source -> last batch)."""
        names = [n for n in self._commits() if n.endswith(".json")]
        if not names:
            return {"version": 0, "tables": {}, "batches": {}}
        return self._load(names[-1])

    def _load(self, commit: str) -> dict:
        where, fs = self._path(f"commits/{commit}")
        stream = fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, state: dict | None = None) -> DataFrame:
        folders = (state or self.state())["tables"].get(table, [])
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*(f"{self.root}/{f}" for f in folders))

    def seen(self, source: str, batch: int) -> bool:
        return batch <= self.state()["batches"].get(source, -1)

    def commit(self, changes: dict[str, tuple[str, DataFrame]], source: str, batch: int) -> bool:
        """Replaces tables (``"replace"``) or adds to them (``"append"``) at once; False if the batch was in already."""
        state = self.state()
        if batch <= state["batches"].get(source, -1):
            return False
        tables = dict(state["tables"])
        for table, (how, df) in changes.items():
            folder = f"data/{table}/{state['version'] + 1:08d}-{uuid.uuid4().hex}"
            df.to(self.spark.createDataFrame([], TABLES[table]).schema).sortWithinPartitions(*LAYOUT[table]).write.parquet(f"{self.root}/{folder}")
            tables[table] = [*tables.get(table, []), folder] if how == "append" else [folder]
        new = {"version": state["version"] + 1, "tables": tables, "batches": state["batches"] | {source: batch}}
        where, fs = self._path(f"commits/{new['version']:08d}.json")
        stream = fs.create(where, False)  # fails if another writer made this version
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        self._clean()
        return True

    def _clean(self) -> None:
        """Deletes folders that none of the last ``keep`` commits names."""
        names = self._commits()
        folders = lambda commit: {f for own in self._load(commit)["tables"].values() for f in own}
        kept = set().union(*(folders(n) for n in names[-self.keep :]))
        for n in names[: -self.keep]:
            for f in folders(n) - kept:
                delete(self.spark, f"{self.root}/{f}")
            delete(self.spark, f"{self.root}/commits/{n}")
