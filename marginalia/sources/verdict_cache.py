"""The verdict cache: a versioned parquet table, latest entry per key."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.lookup import spread_join
from marginalia.schemas import VERDICT_CACHE


def latest(entries: DataFrame) -> DataFrame:
    """The last stored entry per salt and id, combined on the map side."""
    return entries.groupBy("salt", "id").agg(F.max_by(F.struct("verdict", "stored"), "stored").alias("e")).select(
        "salt", "id", "e.verdict", "e.stored")


def look_up(findings: DataFrame, entries: DataFrame, salt: Column, ttl_seconds: float, now: Column,
            spread_by=("file", "ord")) -> DataFrame:
    """Adds ``verdict``, null on a miss: no entry for the key, or one older than the lifetime.

    ``now`` is passed in, so a run sees one time however long it takes; a lifetime of 0 never ends.
    """
    mine = latest(entries.where(F.col("salt") == salt))
    if ttl_seconds > 0:
        age = now.cast("timestamp").cast("double") - F.col("stored").cast("timestamp").cast("double")
        mine = mine.where(age <= F.lit(float(ttl_seconds)))
    return spread_join(findings, mine.select("id", "verdict"), "id", spread_by)


#: A cache of more parts than this is compacted by the next writer, so reading costs what is held and not its history.
MOST_PARTS = 32
#: Superseded versions that stay readable for runs that have just looked one up.
KEPT_VERSIONS = 16


@dataclass(frozen=True)
class VerdictCache:
    """Entries under ``directory``, on storage every executor reaches.

    Every writer adds a part of its own and then publishes a version, a small file that lists the parts that count. A
    version's name is its number and may be made once only, so of two writers one goes first and the other builds
    on it. Readers take the newest version; what it lists never changes.
    """

    spark: SparkSession
    directory: str

    @property
    def path(self) -> str:
        return os.path.join(self.directory, "verdicts")

    def _files(self):
        """Hadoop's file system of the cache, and a maker of paths in it."""
        jvm = self.spark._jvm
        made = jvm.org.apache.hadoop.fs.Path
        return made(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), lambda *names: made("/".join((self.path, *names)))

    def versions(self) -> list[int]:
        """Numbers of the versions there are, oldest first."""
        files, at = self._files()
        if not files.exists(at("versions")):
            return []
        names = [entry.getPath().getName() for entry in files.listStatus(at("versions"))]
        return sorted(int(name) for name in names if name.isdigit())

    def _listed(self, version: int) -> list[str] | None:
        """The parts of a version; None for one whose writer never finished it."""
        files, at = self._files()
        stream = None
        try:
            stream = files.open(at("versions", f"{version:012d}"))
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            return json.loads(text)["parts"]
        except (Py4JJavaError, ValueError, KeyError):
            return None
        finally:
            if stream is not None:
                stream.close()

    def parts(self) -> list[str]:
        """The parts of the newest finished version."""
        for version in reversed(self.versions()):
            if (listed := self._listed(version)) is not None:
                return listed
        return []

    def _publish(self, version: int, parts: list[str]) -> bool:
        """Make a version; False if somebody else has made one of this number."""
        files, at = self._files()
        text = json.dumps({"parts": parts}).encode()
        files.mkdirs(at("versions"))
        path = at("versions", f"{version:012d}")
        if files.getScheme() == "file":  # Hadoop's local file system looks before it creates, which is not one step
            try:
                with open(path.toUri().getPath(), "xb") as out:
                    out.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = files.create(path, False)
        except Py4JJavaError:
            if files.exists(path):
                return False
            raise
        out.write(bytearray(text))
        out.close()
        return True

    def _commit(self, change) -> None:
        """Publish ``change(parts)`` on top of the newest version, whoever else writes; None leaves things as they are."""
        while True:
            known = self.versions()
            wanted = change(self.parts())
            if wanted is None or self._publish((known or [0])[-1] + 1, wanted):
                break
        files, at = self._files()
        for old in known[:-KEPT_VERSIONS]:
            files.delete(at("versions", f"{old:012d}"), False)

    def _write(self, entries: DataFrame) -> str:
        name = uuid.uuid4().hex
        entries.write.parquet(f"{self.path}/parts/{name}")
        return name

    def read(self) -> DataFrame:
        """All entries; an absent or unreadable table is an empty one."""
        return self._read(self.parts())

    def _read(self, parts: list[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], VERDICT_CACHE)
        if not parts:
            return empty
        try:
            found = self.spark.read.parquet(*[f"{self.path}/parts/{name}" for name in parts])
            return found.select(empty.columns)
        except Exception as error:  # noqa: BLE001 - a missing or corrupt cache never fails a run
            if any(name in str(error) for name in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN", "FAILED_READ_FILE")):
                return empty
            raise

    def put(self, verdicts: DataFrame, salt: Column, now: Column) -> None:
        """Store entries; the newest of a key wins on reading (K8)."""
        part = self._write(verdicts.select(salt.alias("salt"), "id", "verdict", now.cast("timestamp").alias("stored")))
        self._commit(lambda parts: [*parts, part])
        if len(self.parts()) > MOST_PARTS:
            self.compact()

    def compact(self) -> None:
        """One part in place of many, an entry per key; parts added meanwhile stay beside it.

        If somebody else has compacted or cleared meanwhile, theirs counts.
        """
        old = self.parts()
        if len(old) < 2:
            return
        part = self._write(latest(self._read(old)))
        self._commit(lambda parts: [part, *(p for p in parts if p not in old)] if set(old) <= set(parts) else None)

    def vacuum(self) -> int:
        """Delete the parts no kept version lists; how many. Not while a writer is between its part and its version."""
        files, at = self._files()
        held = {part for version in self.versions()[-KEPT_VERSIONS:] for part in self._listed(version) or ()}
        gone = [entry.getPath() for entry in (files.listStatus(at("parts")) if files.exists(at("parts")) else ())
                if entry.getPath().getName() not in held]
        for path in gone:
            files.delete(path, True)
        return len(gone)

    def stats(self) -> int:
        """How many verdicts are held (A10)."""
        return latest(self.read()).count()

    def clear(self) -> None:
        """Drop every verdict: a version without parts."""
        self._commit(lambda parts: [])
