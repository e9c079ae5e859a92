"""A source of tagged messages with filters at the source: spark.readStream.format("tagged_messages")."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarrymill.plans.shipping import ship

FIELDS = "tweet_id bigint, created_at string, lang string, text string, entities struct<hashtags: array<struct<text: string>>>"


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Messages:
    """JSON lines of the files of a folder that pass the filters; lines that are no JSON object are left out."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("tagged_messages needs the option path")
        self.folder = urlparse(options["path"]).path
        split = lambda name: [w.strip().lower() for w in options.get(name, "").split(",") if w.strip()]
        self.track, self.languages = split("track"), split("languages")

    def names(self) -> list[str]:
        return sorted(str(p) for p in Path(self.folder).glob("*.json"))

    def kept(self, path: str) -> Iterator[tuple]:
        with open(path, encoding="utf-8", errors="replace") as lines:
            for line in lines:
                try:
                    m = json.loads(line)
                except ValueError:
                    continue
                if isinstance(m, dict) and self._passes(m):
                    yield m.get("tweet_id"), m.get("created_at"), m.get("lang"), m.get("text"), self._entities(m.get("entities"))

    def _passes(self, m: dict) -> bool:
        text, lang = str(m.get("text") or "").lower(), str(m.get("lang") or "").lower()
        return (not self.track or any(w in text for w in self.track)) and (not self.languages or lang in self.languages)

    @staticmethod
    def _entities(e: object) -> tuple | None:
        if not isinstance(e, dict):
            return None
        tags = e.get("hashtags")
        return ([(t.get("text"),) if isinstance(t, dict) else None for t in tags] if isinstance(tags, list) else None,)


class _Reader(DataSourceReader):
    def __init__(self, messages: _Messages):
        self.messages = messages

    def partitions(self) -> list[_File]:
        return [_File(n) for n in self.messages.names()] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return self.messages.kept(partition.value) if partition.value else iter(())


class _StreamReader(DataSourceStreamReader):
    """An offset is the name of the last file read; a batch is the files that follow it, whose names must ascend."""

    def __init__(self, messages: _Messages):
        self.messages = messages

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(self.messages.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(n) for n in self.messages.names() if start["last"] < n <= end["last"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        return self.messages.kept(partition.value)

    def commit(self, end: dict) -> None:
        pass


class TaggedMessages(DataSource):
    """Options: path (a folder of JSON-lines files that every worker sees), track (words separated by commas, one of
    which a message must hold, in any case), languages (likewise, one of which must be its `lang`)."""

    @classmethod
    def name(cls) -> str:
        return "tagged_messages"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> _Reader:
        return _Reader(_Messages(dict(self.options)))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(_Messages(dict(self.options)))


def register(spark: SparkSession) -> None:
    """Make the source known to the session."""
    ship(spark)
    spark.dataSource.register(TaggedMessages)
