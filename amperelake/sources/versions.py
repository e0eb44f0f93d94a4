"""Tables in a shared folder that are published as versions by one small file, one batch after the other."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Behind(RuntimeError):
    """Another writer published first; apply the batch again."""


class VersionedStore:
    """`manifest/<n>.json` is version n: the id of the batch that made it and what its subclass wants to find again, with
    `groups` (name to folder) among it. A batch writes its folders first and then creates manifest n + 1, which must not
    exist: so it is seen wholly or not at all, and of two writers one fails. `applied/<batch id>` finds the version of a
    batch that was applied, whatever came since. Folders that only versions before the last `keep` name are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._path("_").getFileSystem(conf)

    def _names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(folder))) if self._fs.exists(self._path(folder)) else []

    def _read(self, path: str) -> dict:
        f = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(f.readAllBytes()))
        finally:
            f.close()

    def version(self, n: int) -> dict:
        return self._read(f"manifest/{n:012d}.json")

    def _create(self, path: str, what: dict) -> None:
        """Write a small file under a name that must be free: a hidden file is renamed, which fails if the name is taken."""
        jvm, temp = self.spark._jvm, self._path(f"tmp/{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        self._fs.mkdirs(self._path(path).getParent())
        fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            fc.rename(self._fs.makeQualified(temp), self._fs.makeQualified(self._path(path)), none)
        except Exception as e:
            self._fs.delete(temp, False)
            raise Behind(path) from e

    def latest(self) -> tuple[int, dict | None]:
        """Number and content of the newest version; its batch is entered in `applied` if its writer did not get to it."""
        names = [n for n in self._names("manifest") if n.endswith(".json")]
        if not names:
            return 0, None
        n = int(names[-1][:-5])
        m = self.version(n)
        self._enter(m["batch_id"], n)
        return n, m

    def _enter(self, batch_id: int, version: int) -> None:
        if not self._fs.exists(self._path(f"applied/{batch_id}")):
            try:
                self._create(f"applied/{batch_id}", {"version": version})
            except Behind:
                pass

    def applied(self, batch_id: int) -> int | None:
        """The version a batch made, None if it was not applied. Ask `latest` first."""
        return self._read(f"applied/{batch_id}")["version"] if self._fs.exists(self._path(f"applied/{batch_id}")) else None

    def publish(self, n: int, batch_id: int, content: dict) -> int:
        """Make version n + 1; raises `Behind` if there is one."""
        self._create(f"manifest/{n + 1:012d}.json", {"batch_id": batch_id, **content})
        self._enter(batch_id, n + 1)
        if (gone := n + 1 - self.keep) >= 1:
            for f in self._folders(self.version(gone)) - self._folders(self.version(gone + 1)):
                self._fs.delete(self._path(f), True)
        return n + 1

    def _folders(self, m: dict) -> set[str]:
        """Folders that a later version may stop to use; results of batches are none, so that they can be asked for."""
        return {*m["groups"].values()}
