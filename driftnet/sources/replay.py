"""Replays captured packets as a stream: a Python data source over text files in
which each line is ``micros remote_ip remote_port local_ip local_port hex``; a line that
is none is kept in the column ``reject``."""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "recv_ts timestamp, remote_ip string, remote_port int, local_ip string, local_port int, data binary, reject string"
NAME = "packet_replay"


def _row(line: str) -> tuple:
    """A packet, or a row with the line as ``reject`` if it is none."""
    parts = line.split()
    try:
        if len(parts) not in (5, 6):
            raise ValueError(line)
        at = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=int(parts[0]))
        data = bytes.fromhex(parts[5]) if len(parts) == 6 else b""
        return at, parts[1], int(parts[2]), parts[3], int(parts[4]), data, None
    except (ValueError, OverflowError):
        return None, None, None, None, None, None, line.rstrip("\n")


def _files(path: str) -> list[tuple[int, str]]:
    """(time of writing, name) of the captures, in this order."""
    with os.scandir(path) as found:
        return sorted((f.stat().st_mtime_ns, f.name) for f in found if not f.name.startswith(("_", ".")))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        return [_Part(os.path.join(self.path, name)) for _, name in _files(self.path)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path) as f:
            yield from map(_row, f)


class _Stream(DataSourceStreamReader):
    """A partition is a file, read where its task runs; the offset is the time and name of the
    last file that is done, so that files with any name may be added later. Captures are
    complete when they appear in the folder, and are kept."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        last = _files(self.path)[-1:] or [(-1, "")]
        return {"time": last[0][0], "name": last[0][1]}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        low, high = (start["time"], start["name"]), (end["time"], end["name"])
        return [_Part(os.path.join(self.path, f[1])) for f in _files(self.path) if low < f <= high]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path) as f:
            yield from map(_row, f)


class PacketReplay(DataSource):
    """spark.dataSource.register(PacketReplay); option ``path`` is a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> _Batch:
        return _Batch(self.options["path"])

    def streamReader(self, schema: object) -> _Stream:
        return _Stream(self.options["path"])
