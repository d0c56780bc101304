"""Annotation records as a Spark data source: one JSON file an image, read by id and written with a version guard.

``spark.read.format("glyphmill_records").load(folder)`` gives rows (id, version,
json).  A partition is a range of ids.  With the option ``pushdown``, which ``load``
sets where the session allows it (``spark.sql.python.filterPushdown.enabled``),
filters on ids are pushed down, so that one id opens one file.  The version is a
digest of the file.

``df.write.format("glyphmill_records").mode("append").save(folder)`` takes the same
columns, where ``version`` is the one that a writer started from, null for a new
record.  Tasks stage files beside the records; the commit takes the folder's
journal, compares all versions with what is there, and only then moves the files,
so either all records are replaced or none, and of two writers of one record the
second is refused.  A journal that a lost driver left is finished by the next
commit or scan: what it lists is moved if none of it conflicts, else nothing is.

The folder is one that the driver and all executors mount; exclusive creation of a
file there must be atomic.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

NAME, ENDING = "glyphmill_records", ".json"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
JOURNAL, STAGED = "_journal", "_staged"
#: Records that one partition reads.
IDS = 1_000


class Conflict(RuntimeError):
    """A record is no longer the one that a write started from."""


def local(folder: str) -> str:
    """The path of a mounted folder."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"records are kept in a mounted folder, not in {folder}")
    return unquote(parts.path) if parts.scheme else folder


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _path(folder: str, id_: str) -> str:
    if not id_ or "/" in id_ or id_.startswith(("_", ".")):
        raise ValueError(f"{id_!r} can't name a record")
    return f"{folder}/{id_}{ENDING}"


def _version(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return digest(f.read())
    except FileNotFoundError:
        return None


def _settle(folder: str, entries: list[dict]) -> None:
    """Move what a journal lists, or nothing of it; doing it again, or from several places at once, changes nothing."""
    waiting = [e for e in entries if os.path.exists(e["staged"])]
    at = {e["id"]: _version(_path(folder, e["id"])) for e in waiting}
    # moves begin after all comparisons, and no other commit comes between: a record is as it was, or it is moved already
    stale = [e["id"] for e in waiting if at[e["id"]] not in (e["started_from"], e["becomes"])]
    if stale and len(waiting) == len(entries):
        for e in entries:
            _remove(e["staged"])
        raise Conflict(f"changed since they were read: {', '.join(sorted(stale)[:5])}")
    for e in waiting:
        try:
            os.replace(e["staged"], _path(folder, e["id"]))
        except FileNotFoundError:
            pass  # moved from another place


def _remove(path: str) -> None:
    try:
        os.remove(path)
    except FileNotFoundError:
        pass


def recover(folder: str) -> None:
    """Finish a commit that was broken off."""
    path = f"{folder}/{JOURNAL}"
    try:
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)
    except FileNotFoundError:
        return
    try:
        _settle(folder, entries)
    except Conflict:
        pass  # none of it was moved
    _remove(path)


def commit(folder: str, entries: list[dict], tries: int = 100) -> None:
    """Replace all records that the entries (id, started_from, becomes, staged) name, or none."""
    ids = [e["id"] for e in entries]
    if len(set(ids)) < len(ids):
        for e in entries:
            _remove(e["staged"])
        raise Conflict("one write holds a record twice")
    path, mine = f"{folder}/{JOURNAL}", f"{folder}/{STAGED}/journal-{uuid.uuid4().hex}"
    os.makedirs(f"{folder}/{STAGED}", exist_ok=True)
    with open(mine, "w", encoding="utf-8") as f:
        json.dump(entries, f)
        f.flush()
        os.fsync(f.fileno())
    for _ in range(tries):
        try:
            os.link(mine, path)  # whole or not at all, and by one writer only
            break
        except FileExistsError:
            recover(folder)
    else:
        _remove(mine)
        raise Conflict("the folder is busy")
    try:
        _settle(folder, entries)
    finally:
        _remove(path)
        _remove(mine)


@dataclass
class Ids(InputPartition):
    ids: list[str]


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.wanted = folder, None

    def partitions(self) -> list[Ids]:
        recover(self.folder)
        if self.wanted is None:
            with os.scandir(self.folder) as found:
                ids = sorted(e.name.removesuffix(ENDING) for e in found if e.name.endswith(ENDING) and not e.name.startswith(("_", ".")))
        else:
            ids = sorted(i for i in self.wanted if isinstance(i, str) and i)
        return [Ids(ids[k : k + IDS]) for k in range(0, len(ids), IDS)] or [Ids([])]

    def read(self, partition: Ids) -> Iterator[tuple]:
        for id_ in partition.ids:
            try:
                with open(_path(self.folder, id_), "rb") as f:
                    content = f.read()
            except (FileNotFoundError, ValueError):
                continue
            yield id_, digest(content), content.decode("utf-8")


class Pushed(Reader):
    """A reader that opens only the files of the ids that are asked for."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",):
                ids = {f.value}
            elif isinstance(f, In) and f.attribute == ("id",):
                ids = set(f.value)
            else:
                yield f
                continue
            self.wanted = ids if self.wanted is None else self.wanted & ids


@dataclass
class Staged(WriterCommitMessage):
    entries: list[dict]


class Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Staged:
        os.makedirs(f"{self.folder}/{STAGED}", exist_ok=True)
        entries = []
        for r in rows:
            content = r["json"].encode("utf-8")
            _path(self.folder, r["id"])
            staged = f"{self.folder}/{STAGED}/{uuid.uuid4().hex}"
            with open(staged, "wb") as f:
                f.write(content)
            entries.append({"id": r["id"], "started_from": r["version"], "becomes": digest(content), "staged": staged})
        return Staged(entries)

    def commit(self, messages: list[Staged | None]) -> None:
        commit(self.folder, [e for m in messages if m for e in m.entries])

    def abort(self, messages: list[Staged | None]) -> None:
        for m in messages:
            for e in m.entries if m else ():
                _remove(e["staged"])


class Records(DataSource):
    """The data source; ``path`` is the folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "id string, version string, json string"

    def reader(self, schema) -> Reader:
        # a session without pushdown refuses readers that offer it
        return (Pushed if self.options.get("pushdown", "false") == "true" else Reader)(local(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("records are replaced one by one: use mode append")
        folder = local(self.options["path"])
        os.makedirs(folder, exist_ok=True)
        return Writer(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (id, version, json) of all records of a folder."""
    spark.dataSource.register(Records)
    return spark.read.format(NAME).option("pushdown", spark.conf.get(PUSHDOWN, "false")).load(folder)


def save(rows: DataFrame, folder: str) -> None:
    """Write rows (id, version, json), all or none; ``version`` is the one each started from, null for a new record."""
    rows.sparkSession.dataSource.register(Records)
    rows.select("id", "version", "json").write.format(NAME).mode("append").save(folder)
