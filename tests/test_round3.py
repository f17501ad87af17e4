"""Cases that the third round's review found: amounts of nothing, large stored sides, null keys."""

from __future__ import annotations

from datetime import datetime

from ledgerloom.operators import ledger
from tests.compare import assert_same


def test_a_replay_without_an_amount_counts_no_more(spark):
    """draws_fold: a client id counts once, even if its replay or itself has no amount."""
    units = spark.createDataFrame([(1, 9)], "entitlement_id long, remaining_units long")
    rows = [(1, "a", 1, 4), (1, "a", 2, 0), (1, "b", 3, 0), (1, "b", 4, 0), (1, "b", 5, 3), (1, None, 6, 0), (1, None, 7, 0)]
    draws = spark.createDataFrame([(k, c, datetime(2024, 1, d), a) for k, c, d, a in rows], "entitlement_id long, client_id string, created_at timestamp_ntz, amount long")
    assert [tuple(r) for r in ledger.fold_draws(units, draws).collect()] == [(1, 5, 1, 3)]
    told = ledger.draw_results(units, draws).orderBy("created_at").collect()
    assert [r["status"] for r in told] == ["applied", "rejected", "rejected", "rejected", "skipped", "rejected", "rejected"]


def test_a_typed_nought_is_no_cents(spark, duck, tmp_path):
    """typed_amounts: 0.00 is an amount of 0, as in the SQL; the sale's parser still takes positive ones only."""
    from ledgerloom.plans.registry import ORACLES, QUERIES

    rows = [(i, datetime(2024, 1, 1), 1, "view", v, "{}") for i, v in enumerate((0.0, 0.01, 12.5, 299.99, 300.0))]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duck.cursor()
    con.execute(f"create temp view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = QUERIES["typed_amounts"](spark, str(tmp_path))
    assert {r["event_id"]: r["cents"] for r in got.collect()} == {0: 0, 1: 1, 2: 1250, 3: 29999, 4: None}
    assert_same(got, con, ORACLES["typed_amounts"])


def test_stored_keys_are_looked_up_not_listed(spark, tmp_path):
    """load_joined_insert: the pairs of one nation (4 million here) are never made."""
    from ledgerloom.operators import records
    from ledgerloom.plans.registry import QUERIES

    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("c", 1), (None, 1)], "k string, v long")
    stored = lambda rows: rows.where("k = 'b'").select("k")
    done = records.insert_if_absent(batch, "k", ["v"], stored).collect()
    assert {(r["k"], r["v"]): r["disposition"] for r in done} == {
        ("a", 2): "duplicate", ("a", 1): "inserted", ("b", 1): "duplicate", ("c", 1): "inserted", (None, 1): "no_key",
    }

    write = lambda df, name: df.write.parquet(f"{tmp_path}/{name}.parquet")
    write(spark.sql("select id as s_suppkey, if(id < 1990, 1, 2) as s_nationkey from range(2000)"), "supplier")
    write(spark.sql("select id as c_custkey, 1 as c_nationkey from range(2000)"), "customer")
    write(spark.sql("select id as o_orderkey, id as o_custkey from range(2000)"), "orders")
    write(spark.sql("select id as l_orderkey, 1 as l_linenumber, id as l_suppkey, id as l_partkey from range(2000)"), "lineitem")
    out = QUERIES["load_joined_insert"](spark, str(tmp_path))
    assert {r["disposition"]: r["n"] for r in out.collect()} == {"duplicate": 1990, "inserted": 10}
    pairs = [m for m in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in m and "nationkey" in m]
    assert all("custkey" in m for m in pairs), pairs


def test_draws_of_a_stream_by_tables_and_by_keyed_state(spark, tmp_path):
    """stream_draw_results: both kinds of state go on from call to call and tell the same, the last of equal draws included."""
    from collections import Counter

    from ledgerloom.streaming import sync

    units = spark.createDataFrame([(1, 9, datetime(2024, 1, 1).date()), (2, None, None)], "entitlement_id long, remaining_units long, valid_from date")
    schema = "entitlement_id long, client_id string, created_at timestamp_ntz, amount long"
    waves = [
        [(1, "a", 1, 4), (1, None, 2, 2), (1, None, 2, 2), (2, "a", 1, 5), (3, "z", 1, 1)],
        [(1, "a", 3, 1), (1, "b", 3, 2), (1, "b", 4, 1), (1, None, 5, 1), (2, "a", 2, 5), (2, "b", 2, 0), (3, "z", 2, 1)],
        [(1, "c", 6, 1), (2, "b", 3, 1)],
    ]
    told = {}
    for keyed in (False, True):
        for wave in waves:
            part = spark.createDataFrame([(k, c, datetime(2024, 1, d), a) for k, c, d, a in wave], schema).coalesce(1)
            out = sync.stream_draws(units, part, folder=f"file://{tmp_path}/{keyed}", keyed=keyed)
        told[keyed] = Counter((r["entitlement_id"], r["client_id"], r["created_at"].day, r["status"], r["reason"], r["remaining"], r["audit"]) for r in out.collect())
    assert told[False] == told[True]
    assert told[False][(1, None, 2, "applied", None, 3, "update")] == told[False][(1, None, 2, "applied", None, 1, "update")] == 1
    assert told[False][(1, "b", 3, "rejected", "insufficient_units", 1, None)] == 1


def test_actions_without_a_reference_are_dealt_over_all_tasks(spark):
    """apply_batch_results: null references are no hot join key, and an action that waits keeps what was sent."""
    from pyspark.sql import functions as F

    from ledgerloom.streaming.actions import ActionTables

    rows = spark.range(4000).selectExpr("id as _uid", "string(id) as client_id", "'attendance' as entity", "map('player_id', '7') as payload", "timestamp'2024-01-01' as created_at")
    waits = spark.sql("select 9999L as _uid, 'w' as client_id, 'attendance' as entity, map('player_id', 'p', 'session_id', 's') as payload, timestamp'2024-01-01' as created_at")
    known = spark.createDataFrame([("p", "player", 5)], "local_id string, entity string, server_id long")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = ActionTables._resolved(rows.unionByName(waits), known).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    most = max(sum(r["part"] == p for r in out) for p in range(4))
    assert len(out) == 4001 and most < 2000
    assert {(r["_state"], tuple(sorted(r["payload"].items()))) for r in out} == {("ready", (("player_id", "7"),)), ("waiting", (("player_id", "p"), ("session_id", "s")))}


def test_payments_are_counted_in_parts_of_a_fixed_size(spark, monkeypatch):
    """natural_key: more lines make more parts, not larger ones."""
    import ledgerloom.plans.registry as registry
    from ledgerloom.plans import loading
    from tests.conftest import SMALL

    monkeypatch.setattr(loading, "LINES_A_PART", 500)
    assert registry.QUERIES["natural_key"](spark, SMALL).rdd.getNumPartitions() >= 12
