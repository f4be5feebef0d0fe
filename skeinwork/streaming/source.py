"""A directory's changes as a streaming data source.

Offsets count listings. A new listing is compared with the last one, and where it differs it is stored under the next number
in ``log`` before Spark hears of that offset; a batch is the difference of stored listings, so a batch that is run again after
a restart is the same. Listings that no batch can need any more are removed.
"""

from __future__ import annotations

import datetime
import json
import os
import uuid
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

EVENTS = "seq long, ts timestamp, kind string, path string, dest string, size long, mtime_ns long"
#: Events of one listing have numbers below this.
SPAN = 1 << 32


def listing(directory: str) -> dict[str, tuple[int, int]]:
    """{path: (size, mtime_ns)} of the files directly in a directory; none where it isn't there."""
    found = {}
    try:
        with os.scandir(directory) as entries:
            for e in entries:
                try:
                    if e.is_file():
                        s = e.stat()
                        found[os.path.join(directory, e.name)] = (s.st_size, s.st_mtime_ns)
                except FileNotFoundError:  # it went meanwhile
                    continue
    except FileNotFoundError:
        pass
    return found


def differences(old: dict[str, tuple[int, int]], new: dict[str, tuple[int, int]]) -> list[tuple]:
    """(kind, path, dest, size, mtime_ns) from one listing to the next, by path.

    A file that went and one that came with the same size and time are one that moved, unless several are alike.
    """
    went, came = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    by_mark: dict[tuple[int, int], tuple[list, list]] = defaultdict(lambda: ([], []))
    for p in went:
        by_mark[tuple(old[p])][0].append(p)
    for p in came:
        by_mark[tuple(new[p])][1].append(p)
    moved = {a[0]: b[0] for a, b in by_mark.values() if len(a) == len(b) == 1}
    out = [("moved", p, moved[p], *new[moved[p]]) if p in moved else ("deleted", p, None, *old[p]) for p in went]
    out += [("created", p, None, *new[p]) for p in came if p not in moved.values()]
    out += [("modified", p, None, *new[p]) for p in sorted(old.keys() & new.keys()) if tuple(old[p]) != tuple(new[p])]
    return sorted(out, key=lambda r: r[1])


class Listings:
    """Stored listings by number; number 0 is the empty one."""

    def __init__(self, log: str):
        self.log = log.removeprefix("file://").removeprefix("file:")
        os.makedirs(self.log, exist_ok=True)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in os.listdir(self.log) if n.endswith(".json"))

    def read(self, number: int) -> tuple[float, dict[str, tuple[int, int]]]:
        if not number:
            return 0.0, {}
        with open(f"{self.log}/{number:012d}.json", encoding="utf-8") as f:
            data = json.load(f)
        return data["at"], {p: tuple(v) for p, v in data["files"].items()}

    def store(self, number: int, files: dict[str, tuple[int, int]]) -> None:
        temp = f"{self.log}/{uuid.uuid4().hex}.temp"
        with open(temp, "w", encoding="utf-8") as f:
            json.dump({"at": datetime.datetime.now(datetime.UTC).timestamp(), "files": files}, f)
        os.replace(temp, f"{self.log}/{number:012d}.json")

    def forget_before(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                os.remove(f"{self.log}/{n:012d}.json")


class Step(InputPartition):
    def __init__(self, number: int):
        self.number = number


class DirectoryReader(DataSourceStreamReader):
    def __init__(self, directory: str, log: str):
        self.directory, self.log = directory, log

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        stored = Listings(self.log)
        last = max(stored.numbers(), default=0)
        files = listing(self.directory)
        if files != stored.read(last)[1]:
            last += 1
            stored.store(last, files)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Step]:
        return [Step(n) for n in range(start["listing"] + 1, end["listing"] + 1)]

    def read(self, partition: Step) -> Iterator[tuple]:
        stored = Listings(self.log)
        at, new = stored.read(partition.number)
        ts = datetime.datetime.fromtimestamp(at, datetime.UTC)
        for i, (kind, path, dest, size, mtime) in enumerate(differences(stored.read(partition.number - 1)[1], new)):
            yield partition.number * SPAN + i, ts, kind, path, dest, size, mtime

    def commit(self, end: dict) -> None:
        Listings(self.log).forget_before(end["listing"])


class DirectoryChanges(DataSource):
    """``spark.readStream.format("directory_changes").option("path", directory).option("log", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> DirectoryReader:
        return DirectoryReader(os.path.realpath(self.options["path"]), self.options["log"])


def directory_changes(spark: SparkSession, directory: str, log: str):
    """A stream of EVENTS of the files directly in a directory; ``log`` is a folder of its own, used by this stream alone."""
    spark.dataSource.register(DirectoryChanges)
    return spark.readStream.format("directory_changes").option("path", directory).option("log", log).load()
