"""Keyed inserts, the commit log and what lies on it, draws, and document tables."""

import os
import zipfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, records, reports
from ledgerloom.operators.scope import Scope
from ledgerloom.plans import run
from ledgerloom.sources import files, sinks
from ledgerloom.sources.shared import Store
from ledgerloom.streaming import sync


@pytest.fixture
def shuffled(spark):
    """No broadcasts, small partitions: two evaluations of a join deal rows differently."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "32", "spark.sql.files.maxPartitionBytes": "2m"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


# -- keyed inserts ------------------------------------------------------------


def test_a_million_joined_rows_are_all_inserted(shuffled):
    n = 1_000_000
    rows = shuffled.range(n).select(F.col("id"), F.concat(F.lit("key-"), F.col("id").cast("string")).alias("k"), F.lit("x" * 40).alias("v"))
    names = shuffled.range(0, n, 2).select(F.col("id").alias("_id"), F.lit("even").alias("name"))
    batch = rows.join(names, rows["id"] == names["_id"], "left").drop("_id")
    nothing = shuffled.createDataFrame([], "k string")
    done = records.insert_if_absent(batch, "k", ["v"], nothing)
    assert [tuple(r) for r in done.groupBy("disposition").count().collect()] == [("inserted", n)]


def test_repeats_nulls_and_full_ties_behind_a_join(shuffled):
    n = 60_000
    key = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 20_000).cast("string")))
    rows = shuffled.range(n).select((F.col("id") % 7).alias("g"), key.alias("k"), F.lit(1).alias("v"))
    more = shuffled.range(7).select(F.col("id").alias("_g"), F.lit("t").alias("t"))
    batch = rows.join(more, rows["g"] == more["_g"]).drop("_g")
    stored = shuffled.createDataFrame([("k1",), (None,), ("k1",)], "k string")
    done = records.insert_if_absent(batch, "k", ["v"], stored)
    got = {r["disposition"]: r["count"] for r in done.groupBy("disposition").count().collect()}
    keys = Counter(None if i % 10 == 0 else "hot" if i % 3 == 0 else f"k{i % 20_000}" for i in range(n))
    fresh = len(set(keys) - {None, "k1"})
    assert got == {"no_key": keys[None], "inserted": fresh, "duplicate": n - keys[None] - fresh}
    once = done.where("disposition = 'inserted'").groupBy("k").count().where("count > 1")
    assert once.isEmpty() and done.columns == [*batch.columns, "disposition"]


def test_players_with_missing_and_repeated_record_ids(spark):
    body = lambda first, born: {"first_name": first, "last_name": "M", "birth_date": born}
    rows = [(None, 0.9, body("Ann", "2012-01-01")), (None, 0.8, body("Ann", "2012-01-01")), ("r", 0.9, body("Ben", "2012-01-01")), ("r", 0.9, body("Ben", "2012-01-01")), ("s", 0.5, {"first_name": " "})]
    candidates = spark.createDataFrame(rows, "record_id string, confidence_score double, payload map<string,string>")
    nobody = spark.createDataFrame([], "id long, first_name string, last_name string")
    people, told = records.load_players(candidates, nobody)
    assert sorted(r["first_name"] for r in people.collect()) == ["Ann", "Ben"]
    got = Counter((r["record_id"], r["disposition"]) for r in told.collect())
    assert sum(got.values()) == len(rows)
    assert got[None, "inserted"] == got[None, "duplicate"] == got["r", "inserted"] == got["r", "duplicate"] == 1


def test_repeated_ids_multiply_nothing(spark):
    rows = spark.createDataFrame([("l1", 1), ("l2", 2)], "player string, n int")
    known = spark.createDataFrame([("l1", "s2"), ("l1", "s1")], "local_id string, server_id string")
    assert sorted(tuple(r) for r in ledger.resolve_ids(rows, "player", known).collect()) == [("l2", 2), ("s1", 1)]
    asked = spark.createDataFrame([("a", 0)], "custom_id string, ord int")
    out = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z")], "custom_id string, content string")
    assert sorted(tuple(r) for r in ledger.outputs_in_order(asked, out).collect()) == [("a", 0, "x", "answered"), ("b", None, "z", "stray")]
    sent = spark.createDataFrame([("a",), ("b",)], "client_id string")
    said = spark.createDataFrame([("a", "skipped"), ("a", "applied")], "client_id string, status string")
    assert sorted(tuple(r) for r in ledger.sync_statuses(sent, said, "client_id").collect()) == [("a", "applied"), ("b", "unsynced")]


def test_school_contracts_are_a_stream_of_their_own(spark):
    products = spark.createDataFrame([(1, "school_contracts"), (2, "subscription"), (3, "once_off_pass")], "id long, type string")
    people = spark.createDataFrame([(1, 5)], "id long, school_id long")
    payments = spark.createDataFrame([(1, 1, 70, 1), (2, 1, 20, 1), (3, 1, 9, 1), (None, 1, 5, 1)], "product_id long, player_id long, amount_cents long, location_id long")
    assert tuple(reports.revenue_summary(payments, products, people, Scope("founder")).first()) == (0, 20, 70)


# -- commits ------------------------------------------------------------------


def test_commits_are_seen_whole_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    store = Store(spark, folder)
    assert store.table("a", "x int").isEmpty() and not store.done(0)
    store.commit({"a": rows(1), "b": rows(10)}, 0)

    class Broken:
        """A table that can't be written: the commit stops half way."""

        @property
        def write(self):
            raise OSError("disk full")

    with pytest.raises(OSError):
        store.commit({"a": rows(2), "b": Broken()}, 1)
    other = Store(spark, folder)
    read = lambda s, t: sorted(r[0] for r in s.table(t, "x int").collect())
    assert (read(other, "a"), read(other, "b"), other.done(0), other.done(1)) == ([1], [10], True, False)
    other.commit({"a": rows(2), "b": rows(20)}, 1, whole=("b",))
    assert (read(store, "a"), read(store, "b"), store.batches()) == ([1, 2], [20], ["0", "1"])
    store.compact("a", store.table("a", "x int"))
    store.commit({"a": rows(3)}, "next")
    assert read(Store(spark, folder), "a") == [1, 2, 3] and len(store.parts("a")) == 2 and other.done("next")


def test_last_write_table_goes_on_in_a_new_object(spark, tmp_path):
    """Stopped after its first batch, compacted, and gone on with by another object."""
    folder = f"file://{tmp_path}/sync"
    schema = "k string, created_at timestamp, client_id string, value int, seq int"
    edits = lambda *rows: spark.createDataFrame([(k, datetime(2024, 1, d), c, v, i) for i, (k, d, c, v) in enumerate(rows)], schema).coalesce(1)
    rows = lambda df: sorted((r["k"], r["value"]) for r in df.collect())
    assert rows(sync.sync_edits(edits(("a", 2, "x", 1), ("b", 1, "x", 2)), "k", ["value"], folder=folder)) == [("a", 1), ("b", 2)]
    narrow = spark.createDataFrame([], schema).drop("seq").schema
    again = sync.LastWriteTable(spark, f"{folder}/table", "k", ["value"], narrow)
    assert rows(again.read()) == [("a", 1), ("b", 2)] and again.store.done(0)
    again.compact()
    again.apply(edits(("a", 9, "z", 99)), 0)  # a replay of a batch that was committed
    assert rows(again.read()) == [("a", 1), ("b", 2)]
    late = edits(("a", 1, "y", 7), ("b", 3, "x", 5), ("c", 1, "x", 3))
    assert rows(sync.sync_edits(late, "k", ["value"], folder=folder)) == [("a", 1), ("b", 5), ("c", 3)]
    assert sync.LastWriteTable(spark, f"{folder}/table", "k", ["value"], narrow).store.batches() == ["0", "1"]


# -- draws --------------------------------------------------------------------


def _draws(spark, rows):
    schema = "entitlement_id long, client_id string, created_at timestamp_ntz, amount long, signed boolean"
    return spark.createDataFrame([(k, c, datetime(2024, 1, d), a, s) for k, c, d, a, s in rows], schema)


def test_draws_without_ids_are_no_replays(spark):
    units = spark.createDataFrame([(1, 10)], "entitlement_id long, remaining_units long")
    draws = _draws(spark, [(1, None, d, 2, True) for d in (1, 2, 3)] + [(1, "a", 4, 1, True), (1, "a", 5, 1, True)])
    for told in (ledger.draw_results(units, draws), sync.stream_draws(units, draws)):
        got = [(r["status"], r["remaining"]) for r in told.orderBy("created_at").collect()]
        assert got == [("applied", 8), ("applied", 6), ("applied", 4), ("applied", 3), ("skipped", 3)]


def test_rejected_draws_may_come_again(spark):
    """Where only applied draws leave a receipt; receipts from before count in every key."""
    units = spark.createDataFrame([(1, 3), (2, 9)], "entitlement_id long, remaining_units long")
    draws = _draws(spark, [(1, "a", 1, 5, True), (1, "a", 2, 2, True), (1, "a", 3, 1, True), (1, "b", 4, 1, True), (2, "old", 1, 1, True), (2, "c", 2, 1, False), (2, "c", 3, 1, True)])
    before = spark.createDataFrame([("old",), (None,)], "client_id string")
    told = ledger.draw_results(units, draws, receipts=before, rejected_too=False).orderBy("entitlement_id", "created_at")
    got = [(r["status"], r["reason"], r["remaining"]) for r in told.collect()]
    assert got == [
        ("rejected", "insufficient_units", 3), ("applied", None, 1), ("skipped", None, 1), ("applied", None, 0),
        ("skipped", None, 9), ("rejected", "signature_failed", 9), ("applied", None, 8),
    ]
    streamed = sync.stream_draws(units, draws.where("entitlement_id = 1"), rejected_too=False).orderBy("created_at")
    assert [(r["status"], r["reason"], r["remaining"]) for r in streamed.collect()] == got[:4]


def test_batch_and_stream_tell_the_same(spark, tmp_path):
    """Resets, statuses, signatures, unknown keys and amounts, in one batch and over three that a new call goes on with."""
    import random

    rng = random.Random(4)
    rules = [None, {"reset": "monday", "hours_per_week": "1"}, {"units": "9"}]
    held = [(k, rng.choice([None, 0, 50, 90]), rng.choice(["active", "active", "expired"]), rng.choice([None, datetime(2024, 1, 1).date()]), rules[k % 3]) for k in range(9)]
    units = spark.createDataFrame(held, "entitlement_id long, remaining_units long, status string, valid_from date, rules map<string,string>")
    rows = [(rng.randrange(11), rng.choice([None, f"c{rng.randrange(60)}"]), rng.randint(1, 28), rng.choice([None, -1, 10, 20, 40]), rng.random() < 0.8) for _ in range(300)]
    rows = [(k, c, d, a, s) for i, (k, c, d, a, s) in enumerate(sorted(rows, key=lambda r: r[2]))]
    schema = "entitlement_id long, client_id string, created_at timestamp_ntz, amount long, signed boolean"
    draws = spark.createDataFrame([(k, c, datetime(2024, 1, d) + timedelta(seconds=i), a, s) for i, (k, c, d, a, s) in enumerate(rows)], schema)
    want = Counter(map(tuple, ledger.draw_results(units, draws).collect()))
    assert Counter(map(tuple, sync.stream_draws(units, draws).collect())) == want
    folder = f"file://{tmp_path}/draws"
    for days in ((1, 9), (10, 19), (20, 31)):
        part = draws.where(F.dayofmonth("created_at").between(*days))
        told = sync.stream_draws(units, part, folder=folder)
    assert Counter(map(tuple, told.collect())) == want


def test_a_hot_key_of_a_million_draws(spark, monkeypatch):
    units = spark.createDataFrame([(1, 600_000)], "entitlement_id long, remaining_units long")
    n = F.col("id")
    draws = spark.range(1_000_000).select(
        F.lit(1).cast("long").alias("entitlement_id"), F.concat(F.lit("client-0000-0000-0000-"), n.cast("string")).alias("client_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=n)).alias("created_at"), F.lit(1).cast("long").alias("amount"),
    )
    told = ledger.draw_results(units, draws).groupBy("status").agg(F.count("*").alias("n"), F.min("remaining").alias("least"))
    assert {r["status"]: (r["n"], r["least"]) for r in told.collect()} == {"applied": (600_000, 0), "rejected": (400_000, 0)}


def test_a_hot_key_is_told_in_chunks(monkeypatch):
    """The state operator holds a key's batch as columns and hands on results a chunk at a time."""
    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Map(dict):
        def containsKey(self, key):
            return key in self

        def updateValue(self, key, value):
            self[key] = value

    keeper = sync.DrawKeeper("entitlement_id", True, False)
    keeper.units, keeper.receipts = Value(), Map()
    n = 35_000
    frame = pd.DataFrame({
        "entitlement_id": 1, "client_id": [f"c{i}" for i in range(n)], "created_at": pd.date_range("2024-01-01", periods=n, freq="s")[::-1],
        "d_start": n // 2, "d_since": None, "d_period": None, "d_allowance": None, "d_amount": 1, "d_found": True, "d_active": True, "d_signed": True, "d_known": False,
    })
    out = list(keeper.handleInputRows((1,), iter([frame[:20_000], frame[20_000:]]), None))
    assert [len(x) for x in out] == [sync.CHUNK] * 3 + [5_000]
    assert out[0]["client_id"].iloc[0] == f"c{n - 1}" and Counter(pd.concat(out)["status"]) == {"applied": n // 2, "rejected": n // 2}
    assert keeper.units.get() == (0, False, None) and len(keeper.receipts) == n


# -- devices ------------------------------------------------------------------


def _log(spark, *rows):
    return spark.createDataFrame([(k, None if d is None else datetime(2024, 1, 1) + timedelta(days=d)) for k, d in rows], "device_id long, server_timestamp timestamp")


def test_devices_are_told_once_when_five_days_pass(spark, tmp_path):
    folder = f"file://{tmp_path}/devices"
    go = lambda *rows: sorted((r["device_id"], (r["last_sync"] - datetime(2024, 1, 1)).days) for r in sync.stale_devices(_log(spark, *rows), folder=folder).collect())
    assert go((1, 0), (2, 4), (None, 1), (3, None)) == []
    assert go((3, 6)) == [(1, 0)]
    assert go((3, 7)) == [(1, 0)]
    assert go((1, 8), (3, 20)) == [(1, 0), (1, 8), (2, 4)]
    assert go((3, 21)) == [(1, 0), (1, 8), (2, 4)]


def test_devices_by_the_machines_clock(spark, tmp_path):
    import time

    now = datetime.now()
    rows = [(1, now - timedelta(days=9)), (1, now - timedelta(days=6)), (2, now - timedelta(days=6)), (2, now - timedelta(hours=1))]
    log = spark.createDataFrame(rows, "device_id long, server_timestamp timestamp").coalesce(1)
    log.write.parquet(f"{tmp_path}/log")
    told = sync.told_devices(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), clock="ProcessingTime")
    spark.conf.set(sync.STATE_STORE, sync.ON_DISK)
    query = told.writeStream.format("parquet").option("path", f"{tmp_path}/told").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        found = []
        for _ in range(60):
            time.sleep(1)
            found = spark.read.schema(told.schema).parquet(f"{tmp_path}/told").collect() if query.lastProgress else []
            if found:
                break
    finally:
        query.stop()
    assert [(r["device_id"], abs(r["last_sync"] - rows[1][1]) < timedelta(seconds=1)) for r in found] == [(1, True)]


# -- documents ----------------------------------------------------------------


def _cell(said, span=0, merge=None, inside=""):
    grid = f'<w:gridSpan w:val="{span}"/>' if span else ""
    down = "" if merge is None else "<w:vMerge/>" if merge == "" else f'<w:vMerge w:val="{merge}"/>'
    return f"<w:tc><w:tcPr>{grid}{down}</w:tcPr><w:p><w:r><w:t>{said}</w:t></w:r></w:p>{inside}</w:tc>"


def _table(*rows):
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(c if c.startswith('<') else _cell(c) for c in r)}</w:tr>" for r in rows) + "</w:tbl>"


def _metrics(spark, folder, body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    os.makedirs(folder)
    with zipfile.ZipFile(f"{folder}/a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    items = files.read_docx(spark, f"file://{folder}")
    return sorted((r["player_name"], r["metric_type"], r["value"], r["cell"]) for r in records.table_metrics(files.docx_tables(items)).collect())


def test_adjacent_tables_stay_apart(spark, tmp_path):
    body = _table(["Student", "WPM"], ["Ann", "40"]) + _table(["Student", "Quiz 1"], ["Ann", "7"], ["", "9"]) + _table(["Team", "WPM"], ["Red", "1"])
    assert _metrics(spark, f"{tmp_path}/d", body) == [("Ann", "quiz_score", "7", "1-2-1"), ("Ann", "typing_wpm", "40", "0-2-1")]


def test_merged_and_nested_cells_lie_on_the_grid(spark, tmp_path):
    inner = _table(["Student", "Accuracy"], ["Cat", "88"])
    body = _table(
        ["Learner", _cell("Remark", span=2), "WPM"],
        [_cell("Ann", merge="restart"), "a", "b", "41"],
        [_cell("", merge=""), "c", "d", "42"],
        ["Ben", _cell("e", span=2, inside=inner), "43"],
        ["Dan"],
    )
    assert _metrics(spark, f"{tmp_path}/d", body) == [
        ("Ann", "typing_wpm", "41", "0-2-3"), ("Ann", "typing_wpm", "42", "0-3-3"), ("Ben", "typing_wpm", "43", "0-4-3"), ("Cat", "typing_accuracy", "88", "1-2-1"),
    ]


def test_unreadable_documents_say_why(spark, tmp_path):
    os.makedirs(f"{tmp_path}/d")
    (tmp_path / "d" / "a.docx").write_bytes(b"no zip")
    row = files.read_docx(spark, f"file://{tmp_path}/d").first()
    assert row["kind"] == "unreadable" and row["text"].startswith("BadZipFile")


# -- runs ---------------------------------------------------------------------


def _answer(*records):
    return '{"records":[' + ",".join(records) + "]}"


def test_failures_leave_the_run_complete(spark, tmp_path):
    """One unreadable document and one failing call of three: two failed files, which alone are asked again."""
    source = tmp_path / "src"
    for sub in ("cards", "lessons"):
        (source / sub).mkdir(parents=True)
    for name in ("a", "b", "c"):
        (source / "cards" / f"{name}.png").write_bytes(name.encode())
    (source / "lessons" / "bad.docx").write_bytes(b"no zip")
    asked = tmp_path / "asked"

    def client():
        def call(request):
            name = request["path"].rsplit("/", 1)[1]
            with open(asked, "a") as f:
                f.write(name + "\n")
            if name == "b.png" and not (tmp_path / "mended").exists():
                raise ValueError("no such page")
            return _answer('{"target_table":"lessons","confidence":0.9,"payload":{"title":"%s"}}' % name)

        return call

    settings = run.Settings(f"file://{source}", f"file://{tmp_path}/state", retry=run.Retry(first_delay=0))
    nobody = spark.createDataFrame([], "id long, first_name string, last_name string")
    go = lambda **more: run.run_batch(spark, settings, run.Providers({"stub": client}), nobody, run_id="r", **more)
    tables = go()
    counts = run.summary(tables)
    assert (counts["collected"], counts["extracted"], counts["failed"], counts["inserted"]) == (4, 2, 2, 2)
    assert sorted(asked.read_text().split()) == ["a.png", "b.png", "b.png", "b.png", "c.png"]
    manifest = sinks.Manifest(spark, f"file://{tmp_path}/state/r/manifest", "r")
    assert [manifest.stage_status(s) for s in run.STAGES] == ["completed"] * 5
    told = {r["target"].rsplit("/", 1)[1]: r["reason"] for r in manifest.events().where("kind = 'failure'").collect()}
    assert told["b.png"] == "extract_failed: ValueError: no such page" and told["bad.docx"].startswith("docx parse error: BadZipFile")
    absent = {r["target"] for r in manifest.events().where("kind = 'skip' and stage = 'collect'").collect()}
    assert absent == {"registers", "consents", "payments"}
    (tmp_path / "mended").write_text("")
    asked.unlink()
    tables = go(resume=True)
    assert asked.read_text().split() == ["b.png"]
    counts = run.summary(tables)
    assert (counts["extracted"], counts["failed"], counts["inserted"], counts["duplicate"]) == (3, 1, 1, 2)


def test_unanswered_requests_are_asked_one_by_one(spark, tmp_path):
    asked = spark.createDataFrame([(p, "image/png", "x") for p in "abc"], "path string, media_type string, data string")

    def submit(given, out):
        spark.createDataFrame([('{"recordId":"b","modelOutput":{"content":[{"type":"text","text":"yes"}]}}',)], "value string").write.text(out)
        return lambda: "Completed"

    def call(request):
        if request["path"] == "c":
            raise OSError("gone")
        return "alone"

    providers = run.Providers({"one": lambda: call})
    got = run.generate_in_batch(asked, f"file://{tmp_path}/job", submit, one_by_one=lambda left: providers.generate("one", left, run.Retry(2, 0)))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "alone", None), ("b", "yes", None), ("c", None, "OSError: gone")]


def test_a_client_that_cant_be_made_fails_its_calls(spark):
    def broken():
        raise RuntimeError("no key")

    asked = spark.createDataFrame([("a",), ("b",)], "path string")
    told = run.Providers({"p": broken}).generate("p", asked, run.Retry(2, 0)).collect()
    assert {(r["path"], r["content"], r["error"], r["attempts"]) for r in told} == {(p, None, "RuntimeError: no key", 2) for p in "ab"}


def test_archive_of_changed_unchanged_and_reverted_content(spark, tmp_path):
    """One plan row a file in each of four runs; a body is stored once however often it comes back."""
    archive = sinks.Archive(spark, f"file://{tmp_path}/archive")
    seen = []
    for bodies in ({"a": b"one", "b": b"same"}, {"a": b"two", "b": b"same"}, {"a": b"one", "b": b"same", "c": b"two"}, {"a": b"one", "b": b"same", "c": b"two"}):
        files_ = spark.createDataFrame([(f"/in/cards/{k}.png", v) for k, v in bodies.items()], "path string, content binary")
        archive.plan(files_).write.mode("overwrite").parquet(f"file://{tmp_path}/plan")
        plan = spark.read.parquet(f"file://{tmp_path}/plan")
        archive.upload(plan, files_)
        seen.append({r["path"][-5]: r["action"] for r in plan.collect()})
        assert plan.count() == len(bodies)
        assert {r["key"]: bytes(r["content"]) for r in sinks.Archive(spark, f"file://{tmp_path}/archive").read().collect()} == {f"raw/cards/{k}.png": v for k, v in bodies.items()}
    up, skip = "uploaded", "skipped"
    assert seen == [{"a": up, "b": up}, {"a": up, "b": skip}, {"a": up, "b": skip, "c": up}, {"a": skip, "b": skip, "c": skip}]
    assert sorted(bytes(r["content"]) for r in archive.bodies().collect()) == [b"one", b"same", b"two"]


def test_bodies_are_packed_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks.Archive, "PACK_BYTES", 10_000)
    archive = sinks.Archive(spark, f"file://{tmp_path}/archive")
    files_ = spark.range(400).select(F.format_string("/in/cards/%d.png", "id").alias("path"), F.repeat(F.format_string("%04d", "id"), 50).cast("binary").alias("content"))
    archive.plan(files_).write.parquet(f"file://{tmp_path}/plan")
    archive.upload(spark.read.parquet(f"file://{tmp_path}/plan"), files_)
    parts = [p for p in (tmp_path / "archive" / "bodies").rglob("part-*.parquet")]
    assert 4 <= len(parts) <= 9 and archive.read().count() == 400


def test_rows_players_consents_and_audit_are_one_commit(spark, tmp_path, monkeypatch):
    """A load that stops before its commit leaves nothing; the next one loads all of it."""
    source = tmp_path / "src"
    (source / "cards").mkdir(parents=True)
    (source / "cards" / "a.png").write_bytes(b"x")
    said = _answer(
        '{"target_table":"players","confidence":0.9,"payload":{"first_name":"Kabelo","last_name":"M"}}',
        '{"target_table":"payments","confidence":0.9,"payload":{"player_name":"Kabelo M","amount":"R30","paid_at":"2023-12-01"}}',
        '{"target_table":"consents","confidence":0.9,"payload":{"player_name":"Kabelo M","consent_type":"photo"}}',
    )
    nobody = spark.createDataFrame([], "id long, first_name string, last_name string")
    settings = run.Settings(f"file://{source}", f"file://{tmp_path}/state", user="u1")
    go = lambda name: run.run_batch(spark, settings, run.Providers({"stub": lambda: lambda request: said}), nobody, "load", name)
    store = Store(spark, f"file://{tmp_path}/state")
    sizes = lambda: {t: spark.read.parquet(*store.parts(t)).count() if store.parts(t) else 0 for t in ("loaded", "players", "consents", "audit")}

    real = sinks.audit_rows
    monkeypatch.setattr(sinks, "audit_rows", lambda rows, *a: real(rows.withColumn("disposition", F.raise_error(F.lit("crash")).cast("string")), *a))
    with pytest.raises(Exception, match="crash"):
        go("one")
    assert sizes() == {"loaded": 0, "players": 0, "consents": 0, "audit": 0}
    monkeypatch.setattr(sinks, "audit_rows", real)
    go("two")
    assert sizes() == {"loaded": 1, "players": 1, "consents": 1, "audit": 3}
    audit = spark.read.parquet(*store.parts("audit")).collect()
    assert {(r["entity"], r["action"], r["user_id"]) for r in audit} == {(t, "insert", "u1") for t in ("players", "payments", "consents")}
    again = go("three")
    assert sizes() == {"loaded": 1, "players": 1, "consents": 1, "audit": 6}
    assert Counter(r["disposition"] for r in again["load"].collect()) == {"merged": 1, "duplicate": 2}
    assert sinks.AppendOnly(f"file://{tmp_path}/state/consents").read(spark).count() == 1
