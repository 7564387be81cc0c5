"""Hosts as data sources: reports read from, and events delivered through, a small class of the host's own.

    spark.dataSource.register(Reports)  # or hosted(Reports, Port), where workers can't import the host's module
    spark.read.format("daymark_reports").option("port", "host.module:Port").load()
    events.writeStream.format("daymark_wakes").option("port", "host.module:Port").option("receipts", folder).start()

A port is made by Port(options) in each task. For reports it has shards() -> list of names, latest(shard) -> number of
payloads, and read(shard, begin, end) -> (subject, received_at, payload) rows; a shard is a partition. For events it has
wake(event: dict, attempt: int) -> status.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

REPORT = "shard string, place long, subject long, received_at timestamp, payload string"


def port(options: dict, host: type | None = None):
    """The host's port: of the class given, or named by the option `port` as module:Class."""
    if host is not None:
        return host(dict(options))
    module, _, name = options.get("port", "").partition(":")
    if not module or not name:
        raise ValueError("the option port must be module:Class")
    return getattr(importlib.import_module(module), name)(dict(options))


def hosted(source: type[DataSource], host: type) -> type[DataSource]:
    """The data source with a class as its port, which travels with it."""
    return type(source.__name__, (source,), {"host": host})


@dataclass
class Piece(InputPartition):
    shard: str
    begin: int
    end: int


def _rows(host, piece: Piece) -> Iterator[tuple]:
    for place, (subject, at, payload) in enumerate(host.read(piece.shard, piece.begin, piece.end), piece.begin):
        yield piece.shard, place, subject, at, payload


class _Reader(DataSourceReader):
    def __init__(self, options: dict, host: type | None):
        self.options, self.host = options, host

    def partitions(self) -> list[Piece]:
        host = port(self.options, self.host)
        return [Piece(s, 0, host.latest(s)) for s in host.shards()]

    def read(self, partition: Piece) -> Iterator[tuple]:
        yield from _rows(port(self.options, self.host), partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are one number a shard; shards that come later begin at 0."""

    def __init__(self, options: dict, host: type | None):
        self.options, self.host = options, host

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        host = port(self.options, self.host)
        return {s: host.latest(s) for s in host.shards()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(s, start.get(s, 0), n) for s, n in sorted(end.items()) if n > start.get(s, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        yield from _rows(port(self.options, self.host), partition)

    def commit(self, end: dict) -> None:
        pass


class Reports(DataSource):
    """Reports of a host, a partition a shard; read as a table or as a stream."""

    host: type | None = None

    @classmethod
    def name(cls) -> str:
        return "daymark_reports"

    def schema(self) -> str:
        return REPORT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), self.host)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options), self.host)


@dataclass
class Delivered(WriterCommitMessage):
    file: str | None
    rows: int


class _Wakes(DataSourceStreamWriter):
    """Calls the host for each event where the event is, and writes the receipts beside each other in the shared folder.

    A batch that runs again calls again with the same attempt, which the host answers by `duplicate`; of its receipts only
    those count that the commit's list names.
    """

    def __init__(self, options: dict, host: type | None):
        self.options, self.host = options, host
        if "receipts" not in options:
            raise ValueError("the option receipts must name a folder that all executors share")

    def _folder(self):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.options["receipts"])
        where.create_dir(path, recursive=True)
        return where, path

    def write(self, iterator) -> Delivered:
        import uuid

        host, lines = port(self.options, self.host), []
        for row in iterator:
            event = row.asDict(recursive=True)
            status, error = "unknown", None
            try:
                status = host.wake(event, event["attempt"])
            except Exception as problem:  # noqa: BLE001  the host's own
                error = type(problem).__name__
            lines.append(json.dumps({"event_id": event["event_id"], "token": event["token"], "attempt": event["attempt"], "status": status, "error": error}))
        if not lines:
            return Delivered(None, 0)
        where, path = self._folder()
        name = f"part-{uuid.uuid4().hex}.json"
        with where.open_output_stream(f"{path}/{name}") as out:
            out.write(("\n".join(lines) + "\n").encode())
        return Delivered(name, len(lines))

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N802, N803
        where, path = self._folder()
        with where.open_output_stream(f"{path}/_list-{batchId}.json") as out:
            out.write(json.dumps([m.file for m in messages if m is not None and m.file]).encode())

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N802, N803
        pass


class Wakes(DataSource):
    """A sink for claimed events (event_id, token, attempt and any more): each is delivered through the host's port."""

    host: type | None = None

    @classmethod
    def name(cls) -> str:
        return "daymark_wakes"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _Wakes(dict(self.options), self.host)


def receipts(spark, folder: str):
    """The receipts that batches have committed."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    lists = [f.path for f in where.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("_list-")]
    names = [n for p in lists for n in json.loads(where.open_input_stream(p).read())]
    schema = "event_id string, token string, attempt int, status string, error string"
    return spark.read.schema(schema).json([f"{folder}/{n}" for n in names]) if names else spark.createDataFrame([], schema)
