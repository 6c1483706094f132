"""A run in stages that can be taken up again: what is finished and still fits is read, the rest is done, a failure stops."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from narrata.packs import fixed
from narrata.plans.storage import freed_shuffles
from narrata.sources.files import write_object


@dataclass
class StagedRun:
    """Stages that write tables below ``folder``, each under a key of what it was made from.

    A stage's key is a digest of its name, its settings, the version of the rules and the keys of the stages it needs, so
    a changed setting or input makes it and all after it anew, and nothing else. A table is written beside its place and
    renamed into it; the ledger's entry comes last, and only what the ledger names counts as finished.
    """

    spark: SparkSession
    folder: str
    keys: dict[str, str] = field(default_factory=dict)

    def given(self, name: str, digest: str) -> None:
        """An input of the run, known by its digest."""
        self.keys[name] = digest

    def finished(self, name: str) -> bool:
        """Whether the ledger has the stage under its present key."""
        entry = self._entry(name)
        return entry is not None and entry["key"] == self.keys.get(name)

    def stage(self, name: str, make: Callable[[], DataFrame], needs: tuple[str, ...] = (), settings: dict | None = None, check: Callable[[], None] | None = None) -> DataFrame:
        """The table of a stage: as it was written, or else made, written and entered. Needs must have been given or run.

        check: called when the table has been written and before it is entered; what it raises leaves the stage unfinished."""
        if missing := [n for n in needs if n not in self.keys]:
            raise ValueError(f"{name} needs {missing[0]}, which has not run")
        made_of = [name, settings or {}, fixed.PACK_VERSION, [self.keys[n] for n in needs]]
        self.keys[name] = hashlib.sha256(json.dumps(made_of, sort_keys=True, default=str).encode()).hexdigest()
        path = f"{self.folder}/{name}-{self.keys[name][:16]}"
        if self.finished(name):
            entry = self._entry(name)
            return self.spark.read.schema(entry["schema"]).parquet(path)
        rows, part, fs = make(), self._path(f"{path}.part"), self._fs()
        fs.delete(part, True)
        with freed_shuffles(self.spark):
            rows.write.parquet(f"{path}.part")
        if check:
            check()
        fs.delete(self._path(path), True)
        if not fs.rename(part, self._path(path)):
            raise OSError(f"Cannot write {path}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        write_object(self.spark, f"{self.folder}/ledger/{name}.json", {"key": self.keys[name], "schema": schema, "needs": list(needs)})
        return self.spark.read.schema(schema).parquet(path)

    def clear(self) -> None:
        """Delete all tables and the ledger; what a stage returned can no longer be read."""
        self._fs().delete(self._path(self.folder), True)

    def _path(self, text: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, name: str) -> dict | None:
        path = f"{self.folder}/ledger/{name}.json"
        if not self._fs().exists(self._path(path)):
            return None
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])


def listing_digest(spark: SparkSession, path: str) -> str:
    """A digest of the files that a path names: their paths, sizes and times; nothing is read."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    digest, files = hashlib.sha256(), []
    for found in fs.globStatus(target) or []:
        each = fs.listFiles(found.getPath(), True)
        while each.hasNext():
            f = each.next()
            files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    for entry in sorted(files):
        digest.update(json.dumps(entry).encode())
    return digest.hexdigest()
