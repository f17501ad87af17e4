"""Exact dedup as a stateful stream: disk-backed keyed state without expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_CHARS, broadcast_within, materialize, new_path, row_mark, wrapped

_STORE = "spark.sql.streaming.stateStore"
#: Settings while a dedup stream starts: state on disk with bounded native memory,
#: commits as change logs, and no files preallocated for small stores.
STATE_SETTINGS = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "128",
}

#: What the state sees of an arrival; its content stays in the content table.
NARROW = ("locator", "doc_id", "digest", "points", "mark")


def normalized(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def content_rows(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest, whole: bool = False) -> DataFrame:
    """Rows of the content table: id, digest, code points of the original text, mark, row.

    ``row`` holds the text, or with ``whole`` all columns; ``mark`` is a hash over all
    columns, which orders rows that are else alike.
    """
    text = docs["text"]
    return wrapped(
        docs,
        None if whole else ["text"],
        doc_id=docs["doc_id"],
        digest=digest(normalized(text)),
        points=F.coalesce(F.length(text), F.lit(0)).cast("long"),
        mark=row_mark(docs),
    )


def stays_first() -> Column:
    """Order in which equal texts stay: most code points, smallest id (null last), then
    the mark and the locator, which tell repeated rows apart."""
    return F.struct(
        (-F.col("points")).alias("shorter"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id").alias("doc_id"),
        F.col("mark").alias("mark"),
        F.col("locator").alias("locator"),
    )


class ExactDedupStream:
    """Keyed state by digest over arrivals in waves, kept in RocksDB on disk.

    A wave's rows are written to the content table; a row's locator is its place there
    (wave, row).  The narrow columns then go through the stream, a micro-batch a wave.
    State of a digest: rows seen, the row that stays with its stable id, and the locator
    of the first content.  There is no watermark and nothing expires.  Each micro-batch
    writes the digests that it changed, and checks the whole bytes of its hits against
    the content that the state's locator names; rows that differ in spite of an equal
    digest are written beside.  Both go under the batch's number, overwriting what a
    failed try left, so a replay adds nothing.  The state lies in the stream's checkpoint
    in the shared folder; a new run with the same folder goes on where the last ended.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or new_path(spark, "dedup-stream")

    def _table(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        return self.spark.read.parquet(f"{self.folder}/{name}") if there else None

    def content(self) -> DataFrame:
        return self._table("content")

    def observe(self, rows: DataFrame, waves: int = 1) -> None:
        """Take ``rows`` (see ``content_rows``) as arrivals in ``waves`` micro-batches."""
        before = self._table("content")
        last = None if before is None else before.agg(F.max("locator.wave")).first()[0]
        first = 0 if last is None else last + 1
        wave = (F.lit(first) + F.pmod(F.spark_partition_id(), F.lit(waves))).cast("int")
        placed = rows.select(F.struct(wave.alias("wave"), F.monotonically_increasing_id().alias("row")).alias("locator"), "*")
        placed.write.mode("append").parquet(f"{self.folder}/content")
        content = self.content()
        for w in range(first, first + waves):
            # a wave fills whole files, so their statistics keep the others unread; one
            # without rows leaves its number to the next run
            arrived = content.where(F.col("locator.wave") == w).select(*NARROW)
            arrived.write.mode("append").parquet(f"{self.folder}/arrivals/wave={w}")
            self._take(arrived.schema, w)

    def _take(self, schema, wave: int) -> None:
        arrivals = self.spark.readStream.schema(schema).parquet(f"{self.folder}/arrivals/wave=*")
        state = arrivals.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.min(stays_first()).alias("best"), F.min("locator").alias("content")
        )

        def write(batch: DataFrame, number: int) -> None:
            path = f"{self.folder}/changes/batch={number}"
            batch.write.mode("overwrite").parquet(path)
            self._check_bytes(self.spark.read.schema(batch.schema).parquet(path), wave, number)

        before = {name: self.spark.conf.get(name, None) for name in STATE_SETTINGS}
        for name, value in STATE_SETTINGS.items():
            self.spark.conf.set(name, value)
        try:
            query = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.folder}/state")
                .trigger(availableNow=True)
                .foreachBatch(write)
                .start()
            )
            query.awaitTermination()
        finally:
            for name, value in before.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)
        # an empty part, so that a stream without rows has a table too
        self.spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{self.folder}/changes/batch=-1")

    def _check_bytes(self, changed: DataFrame, wave: int, number: int) -> None:
        """Compare the texts of the wave's rows of hit digests with their first content.

        Only texts of hit digests are normalised again and shuffled, as long as the hits
        fit the broadcast bound.  The first contents are a table of one row a digest,
        written out: with no sum between it and the join, Spark can split a hot group's
        rows over tasks.
        """
        hits = changed.where("n > 1").select(F.col("digest").alias("_hit"), F.col("content").alias("_first"))
        n = hits.count()
        if not n:
            return
        few, norm = broadcast_within(hits, n, 200), normalized(F.col("row.text"))
        content = self.content()
        first = content.join(few, F.col("locator") == F.col("_first")).select("_hit", norm.alias("_norm"))
        first = materialize(first, "dedup-first")
        met = content.where(F.col("locator.wave") == wave).join(few.select("_hit"), F.col("digest") == F.col("_hit"), "left_semi")
        differ = met.select("digest", "locator", norm.alias("other")).join(first, F.col("digest") == F.col("_hit"))
        differ.where(F.col("other") != F.col("_norm")).select("digest", "locator", "other").write.mode("overwrite").parquet(
            f"{self.folder}/differing/batch={number}"
        )

    def groups(self) -> DataFrame:
        """Latest state of every digest: digest, n, best, content."""
        seen = self._table("changes")
        latest = seen.groupBy("digest").agg(F.max_by(F.struct("n", "best", "content"), "batch").alias("_s"))
        return latest.select("digest", "_s.*")

    def differing(self) -> DataFrame | None:
        """digest, locator, other: rows whose bytes aren't their digest's first content."""
        return self._table("differing")


def _placed(stream: ExactDedupStream) -> DataFrame:
    """One row per arrival with its group: locator, doc_id, digest, points, keep_id, group_size, kept."""
    arrivals = stream.content().select(*NARROW)
    columns = (
        "locator",
        "doc_id",
        "digest",
        "points",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best.locator") == F.col("locator")).alias("kept"),
    )
    placed = arrivals.join(materialize(stream.groups(), "dedup-groups"), "digest").select(*columns)
    differ = stream.differing()
    if differ is None or differ.isEmpty():
        return placed
    # a digest with two texts: its rows form groups by their whole text
    odd = materialize(differ.select("digest").distinct(), "dedup-odd")
    mixed = materialize(
        arrivals.join(odd, "digest", "left_semi").join(differ.select("locator", "other"), "locator", "left"), "dedup-mixed"
    )
    best = mixed.groupBy("digest", "other").agg(F.count(F.lit(1)).alias("n"), F.min(stays_first()).alias("best"))
    best = best.select(F.col("digest").alias("_d"), F.col("other").alias("_o"), "n", "best")
    again = mixed.join(best, (F.col("digest") == F.col("_d")) & F.col("other").eqNullSafe(F.col("_o"))).select(*columns)
    return placed.join(odd, "digest", "left_anti").select(*again.columns).unionByName(again)


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest, waves: int = 3) -> DataFrame:
    """One row per document: locator, doc_id, digest, points, keep_id, group_size, kept.

    Documents arrive in ``waves`` micro-batches, each of which meets the state that the
    earlier ones left.  A digest that only one row has needs no more; the texts of hit
    digests are compared byte by byte inside the stream.  Null texts are empty ones;
    repeated rows are copies of which one stays.  No rows give no rows.
    """
    stream = ExactDedupStream(docs.sparkSession)
    stream.observe(content_rows(docs, digest), waves)
    return _placed(stream)


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, waves: int = 3) -> DataFrame:
    """``docs`` without the rows whose text another row has, all columns kept.

    Whole rows are the stream's content, so the verdict is on rows: ids may be null or
    repeated, and columns may have any name.  Of repeated rows that differ in other
    columns the one with the smallest hash over all its columns stays.  Only locators
    that go meet the rows, behind a size check.
    """
    stream = ExactDedupStream(docs.sparkSession)
    stream.observe(content_rows(docs, whole=True), waves)
    goes = materialize(_placed(stream).where("not kept").select(F.col("locator").alias("_goes")), "dedup-goes")
    few = broadcast_within(goes, goes.count(), 40)
    return stream.content().join(few, F.col("locator") == F.col("_goes"), "left_anti").select("row.*")
