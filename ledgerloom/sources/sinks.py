"""Sinks: record CSVs, review files, batch input, archive, audit and manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators.records import field, review_rows
from ledgerloom.sources.shared import Store

ENVELOPE = ("record_id", "confidence_score", "source_file", "provider", "extracted_at")
#: Domain columns of the five record files.
PAYLOAD_COLUMNS = {
    "players": ("first_name", "last_name", "birth_date", "grade", "school_name", "guardian_name", "photo_consent"),
    "sessions": ("player_name", "session_type", "started_at", "ended_at", "duration_minutes", "school_name"),
    "payments": ("player_name", "product_name", "amount", "method", "paid_at"),
    "lessons": ("title", "topic", "phenomenon", "content", "source_file"),
    "student_metrics": ("player_name", "lesson_title", "metric_type", "value", "measured_at"),
}
#: What an audit row may say.
AUDIT_ACTIONS = ("insert", "update", "delete", "skip")


def cell(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def record_rows(records: DataFrame, table: str) -> DataFrame:
    """Envelope, then domain columns; a payload's source_file replaces the envelope's."""
    own = PAYLOAD_COLUMNS[table]
    rows = records.where(F.col("target_table") == table)
    head = [cell(F.col(c)).alias(c) for c in ENVELOPE if c in records.columns and c not in own]
    body = []
    for c in own:
        value = field(F.col("payload"), c)
        if c in records.columns:
            value = F.coalesce(value, F.col(c).cast("string"))
        body.append(cell(value).alias(c))
    return rows.select(*head, *body)


def write_record_csvs(records: DataFrame, folder: str) -> list[str]:
    """Five CSV folders, each with a header even when it has no row."""
    paths = []
    for table in PAYLOAD_COLUMNS:
        path = f"{folder}/{table}"
        record_rows(records, table).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
        paths.append(path)
    return paths


def write_review(validated: DataFrame, run_id: str, folder: str) -> str:
    path = f"{folder}/review-{run_id}"
    review_rows(validated).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_batch_input(requests: DataFrame, path: str, system: str, max_tokens: int = 4096) -> None:
    """One JSON line a request, for a model's batch service."""
    source = F.struct(F.lit("base64").alias("type"), "media_type", "data")
    content = F.array(F.struct(F.lit("image").alias("type"), source.alias("source")))
    message = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    body = F.struct(F.lit(max_tokens).alias("max_tokens"), F.lit(system).alias("system"), message.alias("messages"))
    requests.select(F.to_json(F.struct(F.col("path").alias("recordId"), body.alias("modelInput"))).alias("value")).write.text(path)


def archive_plan(files: DataFrame, latest: DataFrame) -> DataFrame:
    """path, key, sha256, length, action: a file is skipped if its key's latest version
    (key, sha256) has the same content, else uploaded.  One row a file."""
    hashed = files.select(
        "path", text.archive_key(F.col("path")).alias("key"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("length")
    )
    there = latest.select("key", F.col("sha256").alias("_there")).dropDuplicates(["key"])
    action = F.when(F.col("_there").eqNullSafe(F.col("sha256")), "skipped").otherwise("uploaded")
    return hashed.join(there, "key", "left").withColumn("action", action).drop("_there")


class Archive:
    """Originals by content: each body is stored once under its digest, packed with others
    in files of bounded size, and the latest version of a key says which body it has.

    A run's bodies and versions are one commit.  Content that comes back to an earlier
    state is a new version of the key, but no new body.
    """

    BODIES = "sha256 string, content binary"
    VERSIONS = "key string, sha256 string, path string, version long"
    #: Bytes of content that a file of bodies holds, about.
    PACK_BYTES = 128 << 20

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Store(spark, folder)

    def bodies(self) -> DataFrame:
        return self.store.table("bodies", self.BODIES)

    def latest(self) -> DataFrame:
        """key, sha256, version: the last one; of files under one key the last path's."""
        newest = F.max(F.struct("version", "path", "sha256")).alias("_v")
        return self.store.table("versions", self.VERSIONS).groupBy("key").agg(newest).select("key", "_v.sha256", "_v.version")

    def plan(self, files: DataFrame) -> DataFrame:
        return archive_plan(files, self.latest())

    def upload(self, plan: DataFrame, files: DataFrame) -> None:
        """Store what the (written) plan uploads: contents that are new, and all versions."""
        wanted = plan.where("action = 'uploaded'")
        firsts = wanted.groupBy("sha256").agg(F.min(F.struct("path", "length")).alias("_f"))
        new = firsts.join(self.bodies().select("sha256"), "sha256", "left_anti").select("sha256", "_f.path", "_f.length")
        size = new.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        bodies = files.select("path", "content").join(new.select("path", "sha256"), "path").select("sha256", "content")
        packed = bodies.repartition(1 + size // self.PACK_BYTES, "sha256")
        versions = wanted.select("key", "sha256", "path", F.lit(self.store.number()).cast("long").alias("version"))
        self.store.commit({"bodies": packed, "versions": versions})

    def read(self) -> DataFrame:
        """key, sha256, content of the latest versions."""
        return self.latest().join(self.bodies(), "sha256").select("key", "sha256", "content")


def audit_rows(dispositions: DataFrame, entity: Column, record: str, device: Column, user: Column, at: Column) -> DataFrame:
    """Audit rows of a batch: an insert, an update or a skip for each disposition."""
    changed = F.col("disposition")
    action = F.when(changed.isin("inserted", "appended"), "insert").when(changed == "merged", "update").otherwise("skip")
    return checked_actions(dispositions.select(
        entity.cast("string").alias("entity"), F.col(record).cast("string").alias("record_id"), action.alias("action"),
        device.cast("string").alias("device_id"), user.cast("string").alias("user_id"), at.alias("server_timestamp"),
    ))


def checked_actions(rows: DataFrame) -> DataFrame:
    """The audit rows; an action that is not one of ``AUDIT_ACTIONS`` is an error."""
    wrong = F.raise_error(F.concat(F.lit("no audit action: "), F.coalesce("action", F.lit("null")))).cast("string")
    return rows.withColumn("action", F.when(F.col("action").isin(*AUDIT_ACTIONS), F.col("action")).otherwise(wrong))


class AppendOnly:
    """A ledger folder: rows are added, and no method changes or removes any.

    A folder that belongs to a ``Store`` is read and added to by the store's commits.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _store(self, spark: SparkSession) -> tuple[Store, str]:
        parent, _, name = self.folder.rpartition("/")
        return Store(spark, parent), name

    def append(self, rows: DataFrame) -> None:
        store, name = self._store(rows.sparkSession)
        if store.parts(name):
            store.commit({name: rows})
        else:
            rows.write.mode("append").parquet(self.folder)

    def revoke(self, consents: DataFrame, at: Column) -> None:
        """A revocation is a further row that grants nothing."""
        self.append(consents.withColumn("granted", F.lit(False)).withColumn("granted_at", at))

    def read(self, spark) -> DataFrame:
        store, name = self._store(spark)
        return spark.read.parquet(*(store.parts(name) or [self.folder]))


MANIFEST = "run_id string, stage string, kind string, target string, status string, reason string"
#: What a stage, and a file or record in it, may be.
STAGE_STATUSES = ("pending", "running", "completed", "failed")


def manifest_state(events: DataFrame) -> DataFrame:
    """Latest status per (run, stage, kind, target) of append-only manifest rows."""
    keys = ["run_id", "stage", "kind", "target"]
    return events.groupBy(*keys).agg(F.max_by("status", "seq").alias("status"), F.max_by("reason", "seq").alias("reason"))


def remaining_files(files: DataFrame, state: DataFrame, stage: str) -> DataFrame:
    """Files that a resumed run still has to do in ``stage``."""
    done = state.where((F.col("stage") == stage) & (F.col("kind") == "file") & (F.col("status") == "done"))
    return files.join(done.select(F.col("target").alias("path")), "path", "left_anti")


class Manifest:
    """What a run has done, as append-only rows below ``folder``.

    A save is written under a name that readers pass over and then renamed, so it is
    seen whole or not at all (where the file system renames at once).  The latest
    row of a stage, file or record holds; skips and failures all stay.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.folder, self.run_id = spark, folder, run_id
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._next = 1 + max([int(s.getPath().getName()[4:]) for s in self._saves(path)], default=0)

    def _saves(self, path) -> list:
        if not self._files.exists(path):
            return []
        return [s for s in self._files.listStatus(path) if s.getPath().getName().startswith("seq=")]

    def exists(self) -> bool:
        return self._next > 1

    def number(self) -> int:
        """The number of the next save."""
        return self._next

    def _save(self, rows: DataFrame) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        hidden, name = f"{self.folder}/_saving-{self._next}", f"{self.folder}/seq={self._next}"
        rows.write.mode("overwrite").parquet(hidden)
        if not self._files.rename(at(hidden), at(name)):
            raise OSError(f"{name} can't be written")
        self._next += 1

    def _told(self, stage: str, kind: str, target: str | None, status: str, reason: str | None = None) -> None:
        self._save(self.spark.createDataFrame([(self.run_id, stage, kind, target, status, reason)], MANIFEST).coalesce(1))

    def start_stage(self, stage: str) -> None:
        self._told(stage, "stage", stage, "running")

    def complete_stage(self, stage: str) -> None:
        self._told(stage, "stage", stage, "completed")

    def fail_stage(self, stage: str, error: str) -> None:
        self._told(stage, "stage", stage, "failed", error)

    def mark(self, stage: str, kind: str, rows: DataFrame) -> None:
        """A row per target: ``rows`` has target, status and reason."""
        head = [F.lit(v).alias(n) for n, v in (("run_id", self.run_id), ("stage", stage), ("kind", kind))]
        self._save(rows.select(*head, F.col("target").cast("string").alias("target"), "status", F.col("reason").cast("string").alias("reason")))

    def record_skip(self, stage: str, target: str, reason: str) -> None:
        self._told(stage, "skip", target, "skipped", reason)

    def record_failure(self, stage: str, target: str, reason: str) -> None:
        self._told(stage, "failure", target, "failed", reason)

    def events(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], f"{MANIFEST}, seq int")
        return self.spark.read.schema(f"{MANIFEST}, seq int").option("basePath", self.folder).parquet(self.folder)

    def state(self) -> DataFrame:
        """Latest rows of stages, files and records."""
        return manifest_state(self.events().where("kind not in ('skip', 'failure')"))

    def stage_status(self, stage: str) -> str:
        row = self.state().where((F.col("kind") == "stage") & (F.col("stage") == stage)).first()
        return "pending" if row is None else row["status"]


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The Parquet table in ``folder``, or an empty one where nothing has been stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.read.schema(schema).parquet(folder)
    return spark.createDataFrame([], schema)


def write_version(rows: DataFrame, folder: str, version: int) -> str:
    """Upsert's last step: a new version beside the old ones."""
    path = f"{folder}/v{version}"
    rows.write.mode("overwrite").parquet(path)
    return path
