"""Sync of offline actions as streams: last write per key, and draws with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ledgerloom.operators import ledger
from ledgerloom.sources.shared import Store, shared_folder, written


class LastWriteTable:
    """Rows by key as the winners of each batch, under a commit log in storage.

    A batch writes what it changes, not the table, and is seen once it is committed; a
    batch that was committed before changes nothing.  Reading takes the newest winner of
    each key; ``compact`` writes that once, as the start of later reads.  The driver
    holds nothing: a new object over the same folder goes on where the last one ended.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, mutable: list[str], schema):
        self.store, self.key, self.mutable, self.schema = Store(spark, folder), key, mutable, schema

    def read(self) -> DataFrame:
        winners = self.store.table("winners", self.schema)
        newest = [F.max_by(m, ledger.version()).alias(m) for m in self.mutable]
        return winners.groupBy(self.key).agg(F.max(ledger.version()).alias("_v"), *newest).select(
            self.key, "_v.created_at", "_v.client_id", *self.mutable
        )

    def apply(self, batch: DataFrame, number: int) -> None:
        """Commit the winners of the batch beside those before it."""
        if not self.store.done(number):
            winners = ledger.last_write(batch, self.key, self.mutable, "seq").select(self.schema.names)
            self.store.commit({"winners": winners}, number)

    def compact(self) -> None:
        """Gather all batches so far in one part; the old ones stay for older readers."""
        self.store.compact("winners", self.read())


def sync_edits(
    edits: DataFrame, key: str, mutable: list[str], files_per_batch: int = 1, folder: str | None = None
) -> DataFrame:
    """Run edits through an available-now stream; returns the table after it.

    The edits are written once as files and streamed by ``files_per_batch``, so
    several batches arrive out of time order; late edits are read and lose.  A later call
    with the same ``folder`` goes on with the table and the stream that lie there.
    """
    spark = edits.sparkSession
    folder = folder or shared_folder(spark, "sync")
    edits.write.mode("append").parquet(f"{folder}/edits")
    schema = edits.select(key, "created_at", "client_id", *mutable).schema
    table = LastWriteTable(spark, f"{folder}/table", key, mutable, schema)
    run_stream(_files(spark, edits.schema, f"{folder}/edits", files_per_batch), table.apply, f"{folder}/stream")
    return table.read()


def _files(spark: SparkSession, schema, folder: str, files_per_batch: int) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def run_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand the micro-batches that are there to ``apply`` and end."""
    query = (
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


DRAW_RESULT = "status string, reason string, remaining long, audit string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_to_files(results: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stateful stream, its state on disk, over what is there into Parquet files."""
    spark = results.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_DISK)
    try:
        query = (
            results.writeStream.format("parquet")
            .option("path", folder)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(STATE_STORE, before)
    query.awaitTermination()


#: Draws that are told at a time.
CHUNK = 10_000


#: Columns that pandas gives another type where values are missing.
_KINDS = {
    "client_id": pa.string(), "d_start": pa.int64(), "d_amount": pa.int64(), "d_allowance": pa.int64(),
    "d_since": pa.date32(), "d_period": pa.date32(),
}


def _as_arrow(frame: pd.DataFrame) -> pa.Table:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    for name, kind in _KINDS.items():
        table = table.set_column(table.schema.get_field_index(name), name, table[name].cast(kind))
    return table


class DrawKeeper(StatefulProcessor):
    """``DrawMachine`` over a stream: draws of one entitlement, in order of time within a
    micro-batch.

    Units and period are one state value; every receipt is an entry of a map on disk, read
    and written by its client id alone, so a batch costs its own rows and not the history.
    A key's rows of a batch are held as Arrow columns, sorted there, and turned into
    objects a chunk at a time.
    """

    def __init__(self, key: str, rejected_too: bool, known_first: bool):
        self.key, self.rejected_too, self.known_first = key, rejected_too, known_first

    def init(self, handle) -> None:
        self.units = handle.getValueState("units", "remaining long, unlimited boolean, since date")
        self.receipts = handle.getMapState("receipts", "client_id string", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pa.concat_tables([_as_arrow(frame) for frame in rows], promote_options="permissive")
        # as in batches: draws without an id last among those of one time, no amount first
        ranked = table.append_column("d_rank", pc.fill_null(table["d_amount"], -(1 << 62)))
        order = pc.sort_indices(ranked, sort_keys=[(c, "ascending") for c in ("created_at", "client_id", "d_rank")])
        machine = None
        for at in range(0, table.num_rows, CHUNK):
            part = table.take(order[at : at + CHUNK])
            columns = {n: part.column(n).to_pylist() for n in ("client_id", *ledger._TOLD)}
            if machine is None:
                machine = self._machine(columns["d_start"][0], columns["d_since"][0])
            told = [self._told(machine, {n: v[k] for n, v in columns.items()}) for k in range(part.num_rows)]
            out = pd.DataFrame(told, columns=["status", "reason", "remaining", "audit"]).astype({"remaining": "Int64"})
            head = part.select([self.key, "client_id", "created_at"]).to_pandas()
            yield pd.concat([head, out], axis=1)
        self.units.update((machine.left or 0, machine.left is None, machine.since))

    def _machine(self, start, since) -> ledger.DrawMachine:
        if not self.units.exists():
            return ledger.DrawMachine(start, since)
        remaining, unlimited, since = self.units.get()
        return ledger.DrawMachine(None if unlimited else remaining, since)

    def _told(self, machine: ledger.DrawMachine, row: dict) -> tuple:
        client = row["client_id"]
        known = client is not None and self.receipts.containsKey((client,))
        replayed = known or row["d_known"]
        if replayed and self.known_first:
            told = ("skipped", None, machine.left, "skip")
        else:
            asked = (row[n] for n in ("d_amount", "d_found", "d_active", "d_period", "d_allowance", "d_signed"))
            told = machine.step(*asked, replayed)
        if client is not None and not known and (self.rejected_too or told[0] == "applied" or row["d_known"]):
            self.receipts.updateValue((client,), (told[0],))
        return told

    def close(self) -> None:
        pass


class DrawTables:
    """Units and receipts of draws as keyed tables that each micro-batch of a stream joins.

    A batch is folded as ``ledger.draws_in_order`` folds it, from the units that the last
    batch of a key has left; its results, units and new receipts are one commit.  Joins
    and one fold a partition, not calls a draw, are what a batch costs; it scans the keys
    of earlier receipts, which ``Store.compact`` gathers.
    """

    def __init__(self, spark: SparkSession, folder: str, entitlements: DataFrame, draws: DataFrame, key: str, today: Column | None, rejected_too: bool, known_first: bool):
        self.store, self.entitlements, self.key, self.today = Store(spark, folder), entitlements, key, today
        self.rejected_too, self.known_first = rejected_too, known_first
        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in draws.select(key, "client_id", "created_at").schema.fields]
        self.schema = ", ".join([*kinds, DRAW_RESULT])
        self.receipts = ", ".join(kinds[:2])
        self.units = f"{kinds[0]}, remaining long, since date, version long"

    def results(self) -> DataFrame:
        return self.store.table("results", self.schema)

    def apply(self, batch: DataFrame, number: int) -> None:
        if self.store.done(number):
            return
        key, there = self.key, self.entitlements
        before = self.store.table("receipts", self.receipts).withColumn("_receipt", F.lit(True))
        asked = batch.withColumn("known", F.coalesce("known", F.lit(False)) if "known" in batch.columns else F.lit(False))
        asked = asked.join(before, [key, "client_id"], "left").withColumn("_old", F.coalesce("_receipt", F.lit(False)))
        draws = asked.withColumn("known", F.col("known") | F.col("_old"))
        units = self.store.table("units", self.units).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct("remaining", "since"), "version").alias("_u"))
        start = F.col("valid_from") if "valid_from" in there.columns else F.lit(None)
        held = there.join(units, there[key] == F.col("_k"), "left").withColumn("valid_from", F.when(F.col("_k").isNull(), start.cast("date")).otherwise(F.col("_u.since")))
        held = held.withColumn("remaining_units", F.when(F.col("_k").isNull(), F.col("remaining_units").cast("long")).otherwise(F.col("_u.remaining"))).drop("_k", "_u")
        told = ledger.draws_in_order(held, draws, key, self.today, None, self.rejected_too, self.known_first)
        told = written(told, "draws-told")
        names = told.columns[:7]
        last = told.groupBy(key).agg(F.max_by(F.struct("remaining", "since"), "nth").alias("_l"))
        left = last.join(there.select(key).distinct(), key, "left_semi").select(key, "_l.*", F.lit(number).cast("long").alias("version"))
        # a known draw leaves a receipt, others if they are applied or all do
        fresh = draws if self.rejected_too else draws.where("known")
        fresh = fresh.where("not _old").select(key, "client_id")
        if not self.rejected_too:
            fresh = fresh.unionByName(told.where("status = 'applied'").select(key, "client_id"))
        receipts = fresh.where("client_id is not null").distinct()
        self.store.commit({"results": told.select(*names), "units": left, "receipts": receipts}, number)


def stream_draws(
    entitlements: DataFrame,
    draws: DataFrame,
    key: str = "entitlement_id",
    today: Column | None = None,
    rejected_too: bool = True,
    known_first: bool = False,
    files_per_batch: int = 0,
    old_receipts: DataFrame | None = None,
    folder: str | None = None,
    keyed: bool = False,
) -> DataFrame:
    """``ledger.draw_results`` of a stream of draws, with state that never expires.

    The entitlements' units are read when a key first comes; then the state has them.
    ``old_receipts`` (key, created_at) were written without client ids: a draw at the time
    of one is skipped, and its client id is a receipt from then on.  With ``known_first`` a
    known id is skipped whatever its amount.  A later call with the same ``folder`` goes
    on with the state that lies there, and returns all results so far.

    The state lies in ``DrawTables``; with ``keyed`` in the state store of a stateful
    operator (``DrawKeeper``), which suits many small batches: it calls the store for each
    draw, but scans no history.  Stay with one of the two for a folder.
    """
    spark = draws.sparkSession
    folder = folder or shared_folder(spark, "draws")
    marked = draws
    if old_receipts is not None:
        old = old_receipts.select(key, "created_at").distinct().withColumn("known", F.lit(True))
        marked = draws.join(old, [key, "created_at"], "left")
    marked.write.mode("append").parquet(f"{folder}/draws")
    stream = _files(spark, marked.schema, f"{folder}/draws", files_per_batch)
    if not keyed:
        tables = DrawTables(spark, f"{folder}/tables", entitlements, marked, key, today, rejected_too, known_first)
        run_stream(stream, tables.apply, f"{folder}/stream")
        return tables.results()
    told = ledger.told_draws(entitlements, stream, key, today)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields[:3]), DRAW_RESULT])
    keeper = DrawKeeper(key, rejected_too, known_first)
    results = told.groupBy(key).transformWithStateInPandas(keeper, schema, "Append", "None")
    state_to_files(results, f"{folder}/results", f"{folder}/stream")
    return spark.read.schema(schema).parquet(f"{folder}/results")


def stateful_draws(draws: DataFrame, files_per_batch: int = 0, old_receipts: DataFrame | None = None) -> DataFrame:
    """Stateful stream of draws (entitlement_id, client_id, created_at, amount,
    start_units): entitlement_id, client_id, status and remaining of each.

    Draws bring their entitlement's units with them.  A client id counts once for an
    entitlement, whatever came of it, and is then skipped; see ``stream_draws``.
    """
    held = draws.groupBy("entitlement_id").agg(F.first("start_units").alias("remaining_units"))
    narrow = draws.select("entitlement_id", "client_id", "created_at", "amount")
    out = stream_draws(
        written(held, "draw-units"), narrow, files_per_batch=files_per_batch, old_receipts=old_receipts, known_first=True
    )
    return out.select("entitlement_id", "client_id", "status", "remaining")


STALE = "device_id long, last_ms long"


class StaleDevices(StatefulProcessor):
    """A device's last sync, and a timer that goes off once when it is too long ago.

    A newer sync moves the timer on and arms it again; older ones change nothing.
    """

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_ms long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(frame["at_ms"].max()) for frame in rows)
        last, told = self.seen.get() if self.seen.exists() else (None, True)
        if last is None or newest > last:
            if not told:
                self.handle.deleteTimer(last + self.after_ms)
            self.seen.update((newest, False))
            self.handle.registerTimer(newest + self.after_ms)
        yield self._row([], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.seen.get()
        if told or expiredTimerInfo.getExpiryTimeInMs() < last + self.after_ms:
            yield self._row([], [])
            return
        self.seen.update((last, True))
        yield self._row([key[0]], [last])

    @staticmethod
    def _row(devices: list, last_ms: list) -> pd.DataFrame:
        return pd.DataFrame({"device_id": devices, "last_ms": last_ms}, dtype="int64")

    def close(self) -> None:
        pass


def told_devices(log: DataFrame, after: timedelta = timedelta(days=5), clock: str = "EventTime", late: str = "0 seconds") -> DataFrame:
    """A streamed sync log (device_id, server_timestamp) as device_id, last_sync of each
    device, once, when its last sync lies ``after`` back.

    With the clock ``EventTime`` time is the log's own, less ``late``, up to which rows may
    come out of order.  With ``ProcessingTime`` it is the machine's; such a query runs
    until it is stopped, as a timer may go off at any time.  State is a row a device
    and never expires.  Rows without a device or a time are left out.
    """
    at = F.col("server_timestamp").cast("timestamp")
    rows = log.where("device_id is not null and server_timestamp is not null")
    rows = rows.select(F.col("device_id").cast("long"), at.alias("server_timestamp"), F.unix_millis(at).alias("at_ms"))
    if clock == "EventTime":
        rows = rows.withWatermark("server_timestamp", late)
    keeper = StaleDevices(int(after.total_seconds() * 1000))
    told = rows.groupBy("device_id").transformWithStateInPandas(keeper, STALE, "Append", clock)
    return told.select("device_id", F.timestamp_millis("last_ms").alias("last_sync"))


def stale_devices(
    log: DataFrame, after: timedelta = timedelta(days=5), late: str = "0 seconds", files_per_batch: int = 0, folder: str | None = None
) -> DataFrame:
    """``told_devices`` of a log that is there, on its own time.

    A later call with the same ``folder`` goes on with the state that lies there, and
    returns all that has been told so far.
    """
    spark = log.sparkSession
    folder = folder or shared_folder(spark, "devices")
    rows = log.select("device_id", F.col("server_timestamp").cast("timestamp").alias("server_timestamp"))
    rows.write.mode("append").parquet(f"{folder}/log")
    told = told_devices(_files(spark, rows.schema, f"{folder}/log", files_per_batch), after, "EventTime", late)
    state_to_files(told, f"{folder}/told", f"{folder}/stream")
    return spark.read.schema(told.schema).parquet(f"{folder}/told")


def latest_by_device(log: DataFrame) -> DataFrame:
    """Latest time per device, for streams and batches alike."""
    return log.groupBy("device_id").agg(F.max("server_timestamp").alias("last_sync"))
