"""Paged services as Spark sources: a batch of requests is a partition, a number of requests an offset.

Nothing but numbers passes through the driver: it asks a service how many requests there
are, and tasks send them. So the number of partitions bounds how many calls run at once,
``batch`` how many requests one call takes, and a stream goes on after the last request
that a finished batch has answered.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.session import ship_package

BATCH = 500


class PagedService(ABC):
    """Requests numbered from 0 that a service answers in batches; later ones may be added, answered ones stay."""

    @abstractmethod
    def size(self, options: dict[str, str]) -> int:
        """How many requests there are by now; asked on the driver."""

    @abstractmethod
    def answer(self, options: dict[str, str], low: int, high: int) -> Iterator[tuple]:
        """Rows for requests ``low`` to ``high`` - 1; called in a task."""


class Requests(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


def _parts(low: int, high: int, batch: int) -> list[Requests]:
    return [Requests(at, min(at + batch, high)) for at in range(low, high, batch)] or [Requests(low, low)]


def _number(options, name: str, default: int) -> int:
    value = int(options.get(name, default))
    if value < 1:
        raise ValueError(f"{name} must be at least 1")
    return value


def register_service(spark: SparkSession, name: str, schema: str, service: PagedService) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read a service's answers.

    The option ``batch`` is the number of requests a call takes, 500 by default; a stream's option
    ``most`` bounds the requests of a micro-batch. All options go to the service. The service is
    sent to the tasks, so it must be picklable.
    """
    ship_package(spark)

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options, self.batch = dict(options), _number(options, "batch", BATCH)

        def partitions(self):
            return _parts(0, service.size(self.options), self.batch)

        def read(self, partition):
            yield from service.answer(self.options, partition.low, partition.high) if partition.high > partition.low else ()

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options):
            self.options, self.batch = dict(options), _number(options, "batch", BATCH)
            self.most, self.at = int(options.get("most", 0)), 0

        def initialOffset(self):
            return {"at": 0}

        def latestOffset(self):
            size = service.size(self.options)
            self.at = min(size, self.at + self.most) if self.most else size
            return {"at": self.at}

        def partitions(self, start, end):
            self.at = max(self.at, end["at"])
            return _parts(start["at"], end["at"], self.batch)

        def read(self, partition):
            yield from service.answer(self.options, partition.low, partition.high) if partition.high > partition.low else ()

        def commit(self, end):
            pass

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

        def streamReader(self, schema):
            return StreamReader(self.options)

    spark.dataSource.register(Source)


class JsonFeed(PagedService):
    """A folder of JSON-lines files, each one request's answer; new files must sort after those there.

    The folder (option ``path``) must be one that driver and executors share. Fields that an entry lacks
    are null; a line that is no JSON object is passed over.
    """

    def __init__(self, fields: list[str]):
        self.fields = fields

    def _files(self, options: dict[str, str]) -> list[Path]:
        return sorted(Path(options["path"]).glob("*.jsonl"))

    def size(self, options: dict[str, str]) -> int:
        return len(self._files(options))

    def answer(self, options: dict[str, str], low: int, high: int) -> Iterator[tuple]:
        for path in self._files(options)[low:high]:
            with path.open(encoding="utf-8") as lines:
                for line in lines:
                    try:
                        entry = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(entry, dict):
                        yield tuple(entry.get(f) for f in self.fields)
