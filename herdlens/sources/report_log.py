"""A table of reports that grows by whole appends, each exactly once.

A folder holds

* ``data/<key>/<attempt>`` - the rows of one attempt to append under a key,
* ``log/<number>.json`` - one line for each append that counts, in order: its key, the
  folder of its rows, and the ids it has taken.

The line is written last, under a number that must not exist yet, and readers follow
the lines only. So an append that failed before its line has added nothing, one that is
repeated under its key adds nothing more, and of two writers at once the second finds
its number taken, takes its ids anew and writes again.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens import schema
from herdlens.sources.tables import stored_rows

ATTEMPTS = 20  # writers that may get in between before an append gives up
_KEY = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,99}")


@dataclass(frozen=True)
class Append:
    key: str
    path: str  # below the folder
    first_id: int  # of the ids taken; beyond the last one if there are no rows
    last_id: int  # highest id of the table up to here
    n_rows: int


class LogConflict(RuntimeError):
    """The number of a line is taken."""


class ReportLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(self._files.getUri(), spark._jsc.hadoopConfiguration())
        self._no_overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)

    def appends(self) -> list[Append]:
        """The lines of the log, in order; one for each append."""
        names = f"{self.folder}/log/*.json"
        if not self._files.globStatus(self._path(names)):
            return []
        rows = self.spark.read.schema("key string, path string, first_id long, last_id long, n_rows long").json(names)
        numbered = rows.withColumn("number", F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long"))
        return [Append(r.key, r.path, r.first_id, r.last_id, r.n_rows) for r in numbered.orderBy("number").collect()]

    def read(self) -> DataFrame:
        """All reports whose append counts."""
        paths = [f"{self.folder}/{a.path}" for a in self.appends()]
        if not paths:
            return self.spark.createDataFrame([], schema.REPORTS)
        return self.spark.read.schema(schema.REPORTS).parquet(*paths)

    def load(self, reports: DataFrame, key: str = "load") -> Append:
        """Append reports that have their ids already."""
        return self._add(key, lambda start: reports.select(*schema.REPORTS.fieldNames()))

    def append(self, scored: DataFrame, key: str, arrival: list) -> Append:
        """Append triaged reports under the next free ids, in the order of ``arrival``.

        An append is named by its ``key``, for instance the id of a batch or of a request.
        """
        return self._add(key, lambda start: stored_rows(scored, start, arrival))

    def _add(self, key: str, rows) -> Append:
        if not _KEY.fullmatch(key):
            raise ValueError(f"a key is up to 100 letters, digits, dots, dashes or underscores: {key!r}")
        for _ in range(ATTEMPTS):
            done = self.appends()
            for a in done:
                if a.key == key:
                    return a
            before = done[-1].last_id if done else 0
            path = f"data/{key}/{uuid.uuid4().hex}"
            rows(before + 1).write.parquet(f"{self.folder}/{path}")
            written = self.spark.read.schema(schema.REPORTS).parquet(f"{self.folder}/{path}")
            last, n = written.agg(F.max("report_id"), F.count(F.lit(1))).first()
            entry = Append(key, path, before + 1, max(before, last or 0), n)
            try:
                self._commit(len(done), entry)
            except LogConflict:
                continue
            self._forget_others(entry)
            return entry
        raise LogConflict(f"{ATTEMPTS} attempts to append {key!r} met other writers")

    def _commit(self, number: int, entry: Append) -> None:
        """Write a line as a whole, or fail if its number is taken."""
        draft = self._path(f"{self.folder}/log/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(asdict(entry)).encode()))
        finally:
            out.close()
        line = self._path(f"{self.folder}/log/{number:012d}.json")
        try:
            self._context.rename(draft, line, self._no_overwrite)
        except Exception as problem:
            self._files.delete(draft, False)
            if self._files.exists(line):
                raise LogConflict(str(line)) from problem
            raise

    def _forget_others(self, entry: Append) -> None:
        """Remove the rows of earlier attempts under the same key."""
        for status in self._files.listStatus(self._path(f"{self.folder}/data/{entry.key}")):
            if not status.getPath().toString().endswith(entry.path):
                self._files.delete(status.getPath(), True)
