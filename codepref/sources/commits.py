"""IO7: partial saves as numbered revisions, and batch prediction that resumes.

Rows are written to a data folder of their own first. A manifest that names the folder
is then renamed to the next free revision number; the rename fails if that number is
taken, so of two writers one takes the next. Readers only see folders that a manifest
names: what a killed run wrote before its manifest is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codepref.functions.text import seeded_hash
from codepref.operators.sanitize import predict


class Folder:
    """Small files in a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at("").getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Names of the files, but for hidden ones."""
        if not self._fs.exists(self._at("")):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(n for n in found if not n.startswith((".", "_")))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def add(self, name: str, value: dict, replace: bool = False) -> bool:
        """Write a file whole or not at all; False if the name is taken."""
        self._fs.mkdirs(self._at(""))
        part = self._at(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(json.dumps(value, sort_keys=True).encode())
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        try:
            self._context.rename(part, self._at(name), how)
            return True
        except Exception:  # noqa: BLE001 - taken, or a failure that another look tells apart
            self._fs.delete(part, False)
            if not self._fs.exists(self._at(name)):
                raise
            return False


class CommitLog:
    """A table that grows by revisions 1, 2, ... under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._manifests = Folder(spark, f"{self.root}/commits")

    def revisions(self) -> list[dict]:
        """The manifests in order: revision, folder, rows, note."""
        return [self._manifests.read(n) for n in self._manifests.names()]

    def commit(self, df: DataFrame, note: str = "") -> int:
        """Write ``df`` and make it the next revision; its number."""
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{folder}")
        rows = self.spark.read.parquet(f"{self.root}/data/{folder}").count()
        while True:
            taken = self._manifests.names()
            revision = int(taken[-1].split(".")[0]) + 1 if taken else 1
            if self._manifests.add(f"{revision:012d}.json", {"revision": revision, "folder": folder, "rows": rows, "note": note}):
                return revision

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The committed rows with their ``revision``, up to one if given; None without any."""
        found = [m for m in self.revisions() if upto is None or m["revision"] <= upto]
        if not found:
            return None
        path = {m["folder"]: m["revision"] for m in found}
        rows = self.spark.read.parquet(*[f"{self.root}/data/{f}" for f in path])
        number = self.spark.createDataFrame(list(path.items()), "_folder string, revision bigint")
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.withColumn("_folder", folder).join(number, "_folder").drop("_folder")


def predict_resumably(df: DataFrame, predictor_factory: Callable, log: CommitLog, key: str, prompt: str = "full_prompt",
                      out: str = "prediction", batches: int = 8, batch_size: int = 8, at_most: int | None = None) -> int:
    """Predict ``df`` in ``batches`` parts by a hash of the key, each saved as a revision;
    the number of revisions made. Rows whose key is committed are left out, so a run
    after a killed one predicts the rest only, whatever its number of parts. ``at_most``
    ends a run after so many revisions. Keys must be unique and not null."""
    made = 0
    for b in range(batches):
        if at_most is not None and made >= at_most:
            break
        part = df.where(seeded_hash(key, "batch") % batches == b)
        done = log.read()
        if done is not None:
            part = part.join(done.select(key), key, "left_anti")
        if part.isEmpty():
            continue
        log.commit(predict(part, predictor_factory, prompt, out, batch_size), f"part {b + 1} of {batches}")
        made += 1
    return made
