"""The stream of actions: results by entity, waiting dependants, replays and restarts."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.scope import Scope
from ledgerloom.streaming import actions


@pytest.fixture
def tables(spark, tmp_path):
    def make(scope=Scope("manager", 1), folder="tables"):
        products = spark.createDataFrame([(7, {"units": "10"}), (8, {"reset": "monday", "hours_per_week": "1"}), (9, None)], "id long, rules map<string,string>")
        out = actions.ActionTables(spark, f"file://{tmp_path}/{folder}", scope, products, F.array(F.lit(3000).cast("long")), "u1")
        people = spark.createDataFrame([(1, "Ann", "A", "2010-01-01", 1, 5), (2, "Ben", "B", None, 2, 6), (3, "Cat", "C", None, 1, 6)], "id long, first_name string, last_name string, birth_date string, location_id long, school_id long")
        held = spark.createDataFrame([(50, 1, 7, "active", 10, 1, 5), (51, 1, 7, "expired", 10, 1, 5), (52, 2, 7, "active", 10, 2, 6)], "id long, player_id long, product_id long, status string, remaining_units long, location_id long, school_id long")
        out.seed(people, held)
        return out

    return make


def sent(spark, *rows):
    """(client id, entity, day, payload) as actions."""
    made = [(c, e, {k: None if v is None else str(v) for k, v in p.items()}, datetime(2024, 1, d)) for c, e, d, p in rows]
    return spark.createDataFrame(made, actions.ACTION).coalesce(1)


def told(df):
    return {r["client_id"]: (r["status"], r["reason"]) for r in df.collect()}


APPLIED, SKIPPED = ("applied", None), ("skipped", None)


def rejected(why):
    return "rejected", why


def test_one_result_an_action(spark, tables):
    """Every entity, every reason, and nothing that goes wrong stops the others."""
    t = tables()
    session = {"player_id": 1, "session_type": "lounge", "started_at": "2024-01-01T10", "ended_at": "2024-01-01T11", "duration_minutes": 60}
    metric = {"player_id": 1, "metric_type": "typing_wpm", "value": "40", "measured_at": "2024-01-01"}
    batch = sent(
        spark,
        ("p1", "player", 1, {"first_name": "Dan", "last_name": "D", "id_number": "77"}), ("p2", "player", 2, {"first_name": " dan", "last_name": "D "}),
        ("p3", "player", 3, {"first_name": "Dan", "last_name": "D", "birth_date": "2011-01-01"}), ("p4", "player", 1, {"first_name": " "}),
        ("p5", "player", 1, {"first_name": "Ann", "last_name": "A", "birth_date": "2010-01-01"}), ("p6", "player", 1, {"first_name": "Eve", "location_id": 2}),
        ("c1", "consent", 1, {"player_id": 1, "consent_type": "photo"}), ("c2", "consent", 1, {"player_id": 2, "consent_type": "photo"}), ("c3", "consent", 1, {"player_id": 1}),
        ("c4", "consent", 1, {}), ("c5", "consent", 1, {"player_id": 99, "consent_type": "photo"}),
        ("s1", "session", 1, session), ("s2", "session", 1, session | {"player_id": 2}), ("s3", "session", 1, {}),
        ("m1", "student_metrics", 1, metric), ("m2", "student_metrics", 1, metric | {"metric_type": "mood"}), ("m3", "student_metrics", 1, metric | {"value": None}),
        ("y1", "payment", 1, {"player_id": 1, "amount": "R30", "paid_at": "2024-01-01"}), ("y2", "payment", 1, {"player_id": 1, "amount": "much", "paid_at": "2024-01-01"}),
        ("e1", "entitlement", 1, {"player_id": 1, "product_id": 7}), ("e2", "entitlement", 1, {"player_id": 1}), ("e3", "entitlement", 1, {"player_id": 1, "product_id": 77}),
        ("d1", "entitlement", 2, {"entitlement_id": 50, "amount": 4}), ("d2", "entitlement", 3, {"entitlement_id": 50, "amount": 7}), ("d3", "entitlement", 1, {"entitlement_id": 51, "amount": 1}),
        ("d4", "entitlement", 1, {"entitlement_id": 52, "amount": 1}), ("d5", "entitlement", 1, {"entitlement_id": 99, "amount": 1}), ("d6", "entitlement", 1, {"entitlement_id": 50, "amount": "x"}),
        ("x1", "invoice", 1, {}), ("x2", None, 1, {}),
    )
    t.apply(batch, 0)
    got = told(t.results())
    assert got == {
        "p1": APPLIED, "p2": SKIPPED, "p3": rejected("unresolved_player"), "p4": rejected("unresolved_player"), "p5": SKIPPED, "p6": rejected("out_of_scope"),
        "c1": APPLIED, "c2": rejected("out_of_scope"), "c3": rejected("consent_type_required"), "c4": rejected("player_required"), "c5": rejected("player_not_found"),
        "s1": APPLIED, "s2": rejected("out_of_scope"), "s3": rejected("player_required"),
        "m1": APPLIED, "m2": rejected("invalid_metric_type"), "m3": rejected("value_required"), "y1": APPLIED, "y2": rejected("bad_amount"),
        "e1": APPLIED, "e2": rejected("player_and_product_required"), "e3": rejected("product_not_found"),
        "d1": APPLIED, "d2": rejected("insufficient_units"), "d3": rejected("inactive"), "d4": rejected("out_of_scope"), "d5": rejected("not_found"), "d6": rejected("invalid_amount"),
        "x1": rejected("unknown_entity"), "x2": rejected("unknown_entity"),
    }
    assert t.results().count() == batch.count()
    ids = {r["client_id"]: r["record_id"] for r in t.results().collect()}
    assert ids["p1"] == ids["p2"] and ids["p5"] == 1
    people = {r["id"]: r for r in t.players().collect()}
    assert len(people) == 4 and people[ids["p1"]]["location_id"] == 1
    units = {r["id"]: r["remaining_units"] for r in t.entitlements().collect()}
    assert units == {50: 6, 51: 10, 52: 10, ids["e1"]: 10}
    rows = {r["entity"]: r["payload"] for r in t.rows().collect()}
    assert set(rows) == {"session", "student_metrics", "payment"} and rows["payment"]["amount_cents"] == "3000"
    assert Counter(r["action"] for r in t.audit().collect()) == {"insert": 6, "skip": 2, "update": 1}

    # a replay of the committed batch, then the same actions sent again: only rejected ones are looked at anew
    t.apply(batch, 0)
    assert t.results().count() == batch.count()
    t.apply(batch, 1)
    again = told(t.results().where("batch = 1"))
    assert {c for c, r in again.items() if r == APPLIED} == set()
    assert {c: again[c] for c in ("p1", "c1", "s1", "m1", "y1", "e1", "d1")} == dict.fromkeys(("p1", "c1", "s1", "m1", "y1", "e1", "d1"), SKIPPED)
    assert {r["id"]: r["remaining_units"] for r in t.entitlements().collect()} == units and t.consents().count() == 1


def test_facilitators_may_sync_a_few_things(spark, tables):
    t = tables(Scope("facilitator", 1, 6))
    session = {"player_id": 3, "started_at": "a", "ended_at": "b"}
    t.apply(sent(
        spark, ("a", "player", 1, {"first_name": "X"}), ("b", "session", 1, session | {"session_type": "lounge"}), ("c", "session", 1, session | {"session_type": "kit"}),
        ("d", "attendance", 1, {"player_id": 3, "attendance_date": "2024-01-01"}), ("e", "session", 1, session | {"player_id": 1, "session_type": "kit"}),
        ("f", "attendance", 2, {"player_id": 3, "session_id": "c", "attendance_date": "2024-01-01"}), ("g", "attendance", 2, {"player_id": 3, "session_id": 12, "attendance_date": "2024-01-01"}),
    ), 0)
    assert told(t.results()) == {
        "a": rejected("forbidden_entity"), "b": rejected("forbidden_session_type"), "c": APPLIED, "d": rejected("session_required"), "e": rejected("out_of_scope"),
        "f": APPLIED, "g": rejected("session_not_found"),
    }


def test_newer_edits_replace_mutable_fields(spark, tables):
    t = tables()
    base = {"player_id": 1, "session_type": "kit", "started_at": "s", "ended_at": "e"}
    edit = lambda client, day, **more: (client, "session", day, base | more)
    payload = lambda: t.rows().first()["payload"]
    t.apply(sent(spark, edit("a", 5, duration_minutes=30, reference="PC1", note="first")), 0)
    t.apply(sent(spark, edit("b", 4, duration_minutes=99), edit("a", 5, duration_minutes=77)), 1)
    assert told(t.results().where("batch = 1")) == {"b": SKIPPED, "a": SKIPPED} and payload()["duration_minutes"] == "30"
    # in one batch: in order of time, whatever the order of arrival
    t.apply(sent(spark, edit("d", 8, duration_minutes=45, note="no"), edit("c", 7, duration_minutes=60, reference="PC2"), edit("c", 7, duration_minutes=61)), 2)
    assert Counter(r["status"] for r in t.results().where("batch = 2").collect()) == {"applied": 2, "skipped": 1}
    assert payload() == base_text(base) | {"duration_minutes": "45", "reference": "PC2", "note": "first"}
    t.apply(sent(spark, edit("e", 9, reference=None)), 3)
    assert payload() == base_text(base) | {"note": "first"}
    assert t.rows().count() == 1 and t.rows().first()["client_id"] == "e"


def base_text(base):
    return {k: str(v) for k, v in base.items()}


def test_dependants_wait_and_go_on_in_another_process(spark, tables, tmp_path):
    """An attendance two batches before its player; then the producers, from new objects over the same folder."""
    folder = f"file://{tmp_path}/stream"
    attends = lambda n: (f"a{n}", "attendance", 3, {"player_id": f"p{n}", "session_id": f"s{n}", "attendance_date": "2024-01-03", "id_number": "77"})
    session = lambda n: (f"s{n}", "session", 2, {"player_id": f"p{n}", "session_type": "kit", "started_at": f"t{n}", "ended_at": "u"})
    go = lambda *rows: told(actions.sync_actions(tables(), sent(spark, *rows), folder))
    assert go(attends(1), attends(2), attends(3)) == {}
    assert go(session(1), session(2), ("m", "student_metrics", 2, {"player_id": "p2", "metric_type": "quiz_score", "value": "7"})) == {}
    t = tables()
    assert {r["client_id"] for r in t.waiting().collect()} == {"a1", "a2", "a3", "s1", "s2", "m"}
    assert not any("id_number" in r["payload"] for r in t.waiting().collect())
    got = go(("p1", "player", 1, {"first_name": "New", "last_name": "N"}), ("p2", "player", 1, {"first_name": ""}))
    refused = rejected("producer_rejected")
    assert got == {"p1": APPLIED, "s1": APPLIED, "a1": APPLIED, "p2": rejected("unresolved_player"), "s2": refused, "a2": refused, "m": refused}
    assert {r["client_id"] for r in tables().waiting().collect()} == {"a3"}
    # the rest comes in one batch, dependants first; another client's copy of a player resolves too
    got = go(attends(4), session(4), ("p4", "player", 1, {"first_name": "new", "last_name": "n"}), session(3), ("p3", "player", 1, {"first_name": "Fox"}))
    assert {c: got[c] for c in ("p3", "s3", "a3", "p4", "s4", "a4")} == {"p3": APPLIED, "s3": APPLIED, "a3": APPLIED, "p4": SKIPPED, "s4": APPLIED, "a4": APPLIED}
    t = tables()
    player = {r["client_id"]: r["record_id"] for r in t.results().collect()}
    rows = {r["client_id"]: r for r in t.rows().collect()}
    assert rows["a4"]["player_id"] == player["p1"] == player["p4"] and rows["a4"]["payload"]["session_id"] == str(player["s4"])
    assert t.waiting().isEmpty()


def test_a_batch_that_stops_before_its_commit_is_done_again(spark, tables, monkeypatch):
    t = tables()
    batch = sent(spark, ("d1", "entitlement", 2, {"entitlement_id": 50, "amount": 4}), ("c1", "consent", 1, {"player_id": 1, "consent_type": "photo"}))
    commit = t.store.commit

    def crash(rows, *a, **b):
        for name in ("results", "entitlements", "consents"):
            rows[name].write.parquet(f"{t.store.folder}/{name}/999-lost")
        raise OSError("gone")

    monkeypatch.setattr(t.store, "commit", crash)
    with pytest.raises(OSError):
        t.apply(batch, 0)
    monkeypatch.setattr(t.store, "commit", commit)
    assert t.results().isEmpty() and {r["remaining_units"] for r in t.entitlements().where("id = 50").collect()} == {10}
    t.apply(batch, 0)
    assert told(t.results()) == {"d1": APPLIED, "c1": APPLIED} and t.entitlements().where("id = 50").first()["remaining_units"] == 6


def test_empty_and_odd_batches(spark, tables):
    t = tables()
    t.apply(sent(spark), 0)
    odd = spark.createDataFrame([(None, "consent", None, None), (None, "player", {"first_name": "Zed", "last_name": "Z"}, None), ("r", "payment", {"player_id": "1", "amount": "R5"}, None)], actions.ACTION)
    t.apply(odd.unionByName(odd), 1)
    got = Counter((r["entity"], r["status"], r["reason"]) for r in t.results().collect())
    assert got == {("consent", "rejected", "player_required"): 2, ("player", "applied", None): 1, ("player", "skipped", None): 1, ("payment", "applied", None): 1, ("payment", "skipped", None): 1}
