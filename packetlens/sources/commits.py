"""Committed folders: what a run writes counts as a whole, once, or not at all.

A run writes into a folder of its own below ``data``; when that has succeeded, a
small manifest below ``_runs`` names it. Readers read the folders that
manifests name, so half a write is never seen, a failed one leaves nothing that
counts, and a run that is repeated under its old name changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._=-]*")


@dataclass(frozen=True)
class Run:
    """A committed run: its name, the folder of its files, its number, and whether it takes the place of all runs before it."""

    name: str
    path: str
    number: int
    replaces: bool


class Folder:
    """A folder of committed runs, in any store that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifests(self) -> list[Run]:
        at = self._at("_runs")
        if not self._files.exists(at):
            return []
        out = []
        for status in self._files.listStatus(at):
            stream = self._files.open(status.getPath())
            try:
                said = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if said.endswith("}"):  # else it is being written, or its writer died
                out.append(Run(**json.loads(said)))
        return sorted(out, key=lambda r: (r.number, r.name))

    def runs(self) -> list[Run]:
        """The runs that count, in order."""
        all_ = self._manifests()
        first = max((r.number for r in all_ if r.replaces), default=0)
        return [r for r in all_ if r.number >= first]

    def commit(self, run: str, write: Callable[[str], None], replace: bool = False) -> bool:
        """Lets ``write`` fill a fresh folder, then commits it; false if the run was there already, which then stays as it is.

        With ``replace`` the run takes the place of all before it. An error of
        ``write`` is raised again after its files have been removed.
        """
        if not _NAME.fullmatch(run):
            raise ValueError(f"a run's name is made of letters, digits and ._=-, not {run!r}")
        known = self._manifests()
        if any(r.name == run for r in known):
            return False
        own = f"data/{run}.{uuid.uuid4().hex[:12]}"
        try:
            write(f"{self.path}/{own}")
        except BaseException:
            self._files.delete(self._at(own), True)
            raise
        manifest = Run(run, f"{self.path}/{own}", max((r.number for r in known), default=0) + 1, replace)
        if not self._create(f"_runs/{run}", json.dumps(manifest.__dict__)):
            self._files.delete(self._at(own), True)
            return False
        return True

    def _create(self, name: str, content: str) -> bool:
        """A new file; false if another writer made it first and has ended it."""
        at = self._at(name)
        if self._files.exists(at) and not any(r.name == at.getName() for r in self._manifests()):
            self._files.delete(at, False)  # left by a writer that died
        try:
            stream = self._files.create(at, False)
        except Exception as error:
            if "exists" in str(error):
                return False
            raise
        stream.write(bytearray(content.encode()))
        stream.close()
        return True

    def read(self, load: Callable[[list[str]], DataFrame], empty: DataFrame) -> DataFrame:
        """What the committed runs hold: ``load`` of their folders, or ``empty``."""
        paths = [r.path for r in self.runs()]
        return load(paths) if paths else empty

    def tidy(self) -> int:
        """Removes what no run that counts needs: folders that were never committed, and replaced runs with their manifests. For when nobody writes."""
        kept, gone = self.runs(), 0
        paths = {r.path.rsplit("/", 1)[1] for r in kept}
        for r in self._manifests():
            if r not in kept:
                self._files.delete(self._at(f"_runs/{r.name}"), False)
        if self._files.exists(self._at("data")):
            for status in self._files.listStatus(self._at("data")):
                if status.getPath().getName() not in paths:
                    gone += self._files.delete(status.getPath(), True)
        return gone
