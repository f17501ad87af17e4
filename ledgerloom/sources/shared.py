"""Shared storage: tables written once, and a commit log that makes many of them one."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's checkpoint folder.

    A local one only where none is set and all runs in one process (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, until the driver's JVM ends.

    What is compared with itself later must be written first: two evaluations of a plan
    behind a shuffle give rows in another order, so a row's place in it is no identity.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df`` with a number of its own for each row, written with the rows."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), label)


class Store:
    """Named tables in a folder, changed by commits that are seen whole or not at all.

    A commit writes its parts of the tables under a new number and then one file that
    lists them, under another name first and renamed.  Readers go by these files alone,
    so what a failed try has left is never read, and a new object over the same folder
    finds what was committed.  A part adds rows; a ``whole`` part replaces the table's
    earlier ones.  ``batch`` names the work that a commit is for: ``done`` tells a
    replayed batch that it has nothing to do.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._read: dict[str, dict] = {}

    def _commits(self) -> list[str]:
        log = self._path(f"{self.folder}/commits")
        names = [s.getPath().getName() for s in self._files.listStatus(log)] if self._files.exists(log) else []
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("_"))

    def _told(self, name: str) -> dict:
        if name not in self._read:
            stream = self._files.open(self._path(f"{self.folder}/commits/{name}"))
            try:
                self._read[name] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._read[name]

    def batches(self) -> list[str]:
        """Names of the committed batches, in order."""
        return [self._told(n)["batch"] for n in self._commits() if self._told(n)["batch"] is not None]

    def number(self) -> int:
        """The number that the next commit gets."""
        last = self._commits()
        return int(last[-1].split(".")[0]) + 1 if last else 0

    def done(self, batch: str | int) -> bool:
        return any(self._told(n)["batch"] == str(batch) for n in reversed(self._commits()))

    def parts(self, table: str) -> list[str]:
        """Folders of the table's rows, from its last whole part on."""
        paths: list[str] = []
        for name in self._commits():
            kind, part = self._told(name)["tables"].get(table, (None, None))
            if kind is not None:
                paths = [part] if kind == "whole" else [*paths, part]
        return [f"{self.folder}/{p}" for p in paths]

    def table(self, table: str, schema) -> DataFrame:
        """The committed rows; an empty table where there are none."""
        paths = self.parts(table)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, rows: dict[str, DataFrame], batch: str | int | None = None, whole: tuple[str, ...] = ()) -> None:
        """Write the rows of all tables, then make them seen at once."""
        number, tables = self.number(), {}
        for table, df in rows.items():
            part = f"{table}/{number:012d}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.folder}/{part}")
            tables[table] = ("whole" if table in whole else "part", part)
        hidden, name = (self._path(f"{self.folder}/commits/{n}") for n in (f"_{number:012d}.json", f"{number:012d}.json"))
        out = self._files.create(hidden, True)
        try:
            out.write(bytearray(json.dumps({"batch": None if batch is None else str(batch), "tables": tables}).encode()))
        finally:
            out.close()
        if self._files.exists(name) or not self._files.rename(hidden, name):
            raise OSError(f"{name} was written meanwhile or can't be")

    def compact(self, table: str, rows: DataFrame) -> None:
        """Replace the table's parts by ``rows``, read from them; old ones stay for older readers."""
        self.commit({table: rows}, whole=(table,))
