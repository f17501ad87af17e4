"""Reports and alerts over scoped tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.scope import Scope

NO_SESSION_DAYS, UNSYNCED_DAYS, HORIZON_DAYS = 7, 5, 7
#: The streams of the summary and the product types that they take in; a
#: pass is in none, and no product has the last type today.
STREAMS = {
    "pay_per_use_cents": ("pay_per_use",),
    "subscription_cents": ("subscription",),
    "school_contracts_cents": ("school_contracts",),
}


def _moment(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _day(value: date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def revenue_summary(payments: DataFrame, products: DataFrame, players: DataFrame, scope: Scope) -> DataFrame:
    """One row with the three streams; payments without a product are in none.

    One conditional sum, so an empty input still gives a row of zeros.
    """
    pay = payments.select("product_id", "player_id", "amount_cents", "location_id")
    kinds = products.select(F.col("id").alias("_product"), "type")
    people = players.select(F.col("id").alias("_player"), "school_id")
    joined = pay.join(kinds, pay["product_id"] == F.col("_product")).join(people, pay["player_id"] == F.col("_player"))
    seen = joined.where(scope.reads(F.col("location_id"), F.col("school_id")))
    return seen.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("type").isin(*types), F.col("amount_cents"))), F.lit(0)).alias(name)
            for name, types in STREAMS.items()
        ]
    )


def revenue_by_type(payments: DataFrame, products: DataFrame) -> DataFrame:
    kinds = products.select(F.col("id").alias("product_id"), "type")
    return payments.join(kinds, "product_id").groupBy("type").agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("cents"))


def revenue_rows(summary: DataFrame) -> DataFrame:
    """The summary as three labelled rows; the contract row is always there."""
    return summary.unpivot([], list(STREAMS), "stream", "cents")


def without_recent_session(players: DataFrame, sessions: DataFrame, scope: Scope, now: datetime) -> DataFrame:
    """Active players in scope without a session in the last days, wherever it was."""
    cutoff = _moment(now - timedelta(days=NO_SESSION_DAYS))
    recent = sessions.where(F.coalesce("started_at", "created_at") >= cutoff).select(F.col("player_id").alias("id"))
    return players.where(F.col("active") & scope.reads(F.col("location_id"), F.col("school_id"))).join(recent, "id", "left_anti").select("id")


def expiring_entitlements(
    entitlements: DataFrame, players: DataFrame, scope: Scope, now: datetime, horizon: int = HORIZON_DAYS
) -> DataFrame:
    """Active entitlements that end within the horizon, both ends included; UTC days."""
    today = now.date()
    e = entitlements.where(
        (F.col("status") == "active")
        & F.col("valid_to").isNotNull()
        & F.col("valid_to").between(_day(today), _day(today + timedelta(days=horizon)))
    )
    return _of_players(e, players, scope).select("id")


def due_subscriptions(
    entitlements: DataFrame, products: DataFrame, players: DataFrame, scope: Scope, now: datetime
) -> DataFrame:
    due = entitlements.where(
        (F.col("status") == "active") & F.col("valid_to").isNotNull() & (F.col("valid_to") <= _day(now.date()))
    )
    plans = products.where(F.col("type") == "subscription").select(F.col("id").alias("product_id"))
    return _of_players(due.join(plans, "product_id", "left_semi"), players, scope).select("id")


def _of_players(rows: DataFrame, players: DataFrame, scope: Scope) -> DataFrame:
    people = players.select(F.col("id").alias("_player"), F.col("school_id").alias("_school"))
    joined = rows.join(people, rows["player_id"] == F.col("_player"))
    return joined.where(scope.reads(rows["location_id"], F.col("_school")))


def unsynced_devices(sync_log: DataFrame, scope: Scope, now: datetime) -> DataFrame:
    """Devices whose last sync lies more than five days back; scoped by location only."""
    cutoff = _moment(now - timedelta(days=UNSYNCED_DAYS))
    seen = sync_log.where(F.col("device_id").isNotNull() & scope.reads(F.col("location_id")))
    return seen.groupBy("device_id").agg(F.max("server_timestamp").alias("last_sync")).where(F.col("last_sync") < cutoff)


def all_alerts(tables: dict[str, DataFrame], scope: Scope, now: datetime, horizon: int = HORIZON_DAYS) -> DataFrame:
    """(rule_no, alert, subject_id, detail) of the four rules."""
    p, e = tables["players"], tables["entitlements"]

    def tagged(rows: DataFrame, column: str, number: int, name: str, detail: str) -> DataFrame:
        return rows.select(
            F.lit(number).alias("rule_no"), F.lit(name).alias("alert"), F.col(column).cast("string").alias("subject_id"),
            F.lit(detail).alias("detail"),
        )

    return (
        tagged(without_recent_session(p, tables["sessions"], scope, now), "id", 1, "no_recent_session", "no session in 7 days")
        .unionByName(tagged(expiring_entitlements(e, p, scope, now, horizon), "id", 2, "entitlement_expiring", "entitlement expiring within horizon"))
        .unionByName(tagged(due_subscriptions(e, tables["products"], p, scope, now), "id", 3, "subscription_due", "subscription renewal due"))
        .unionByName(tagged(unsynced_devices(tables["sync_log"], scope, now), "device_id", 4, "unsynced_device", "device last sync > 5 days"))
    )


def roster(players: DataFrame, scope: Scope, search: str = "") -> DataFrame:
    """Players in scope whose full name contains the search text; blank finds all."""
    seen = players.where(scope.reads(F.col("location_id"), F.col("school_id")))
    name = F.concat_ws(" ", "first_name", "last_name")
    needle = search.strip().lower()
    return (seen.where(F.contains(F.lower(name), F.lit(needle))) if needle else seen).select(
        "id", name.alias("name"), "school_id", "location_id", "active"
    )


def draw_history(sync_log: DataFrame, entitlements: DataFrame, players: DataFrame) -> DataFrame:
    """Audited updates of entitlements with their players."""
    draws = sync_log.where((F.col("entity") == "entitlement") & (F.col("action") == "update"))
    e = entitlements.select(F.col("id").alias("record_id"), "player_id", "product_id")
    p = players.select(F.col("id").alias("player_id"), "first_name", "last_name")
    return draws.select("id", "record_id", "server_timestamp").join(e, "record_id").join(p, "player_id")


def balances(entitlements: DataFrame, players: DataFrame, scope: Scope) -> DataFrame:
    """Active entitlements of players in scope; no due reset is applied."""
    active = entitlements.where(F.col("status") == "active").select("id", "player_id", "product_id", "remaining_units", "location_id")
    people = players.select(F.col("id").alias("_player"), "school_id")
    joined = active.join(people, active["player_id"] == F.col("_player"))
    return joined.where(scope.reads(F.col("location_id"), F.col("school_id"))).select(
        "id", "player_id", "product_id", "remaining_units"
    )


def balance_rollup(players: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Per player: summed units ('unlimited' if any is null), status, number held.

    Status is 'active' if any is, else that of the first entitlement, else 'none'.
    """
    held = entitlements.groupBy("player_id").agg(
        F.bool_or(F.col("remaining_units").isNull()).alias("_unlimited"),
        F.sum("remaining_units").alias("_units"),
        F.bool_or(F.col("status") == "active").alias("_active"),
        F.min_by("status", "id").alias("_first"),
        F.count(F.lit(1)).alias("held"),
    )
    p = players.select(F.col("id").alias("player_id"))
    return p.join(held, "player_id", "left").select(
        "player_id",
        F.when(F.col("_unlimited"), "unlimited").otherwise(F.col("_units").cast("string")).alias("balance"),
        F.when(F.col("_active"), "active").otherwise(F.coalesce("_first", F.lit("none"))).alias("status"),
        F.coalesce("held", F.lit(0)).alias("held"),
    )


def last_visits(players: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every player with the day of the last session; null without one."""
    day = F.to_date(F.coalesce("started_at", "created_at"))
    last = sessions.groupBy(F.col("player_id").alias("id")).agg(F.max(day).alias("last_visit"))
    return players.select("id").join(last, "id", "left")


def today_totals(payments: DataFrame, sessions: DataFrame, day: date, goal_cents: int = 55_000) -> DataFrame:
    """Cash taken and sessions of one day, and the share of the day's goal."""
    cash = payments.where((F.col("paid_on") == _day(day)) & (F.col("method").isNull() | (F.col("method") == "cash")))
    visits = sessions.where(F.to_date(F.coalesce("started_at", "created_at")) == _day(day))
    rows = cash.select("amount_cents", F.lit(True).alias("paid")).unionByName(
        visits.select(F.lit(None).cast("long").alias("amount_cents"), F.lit(False).alias("paid"))
    )
    totals = rows.agg(
        F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("cash_cents"),
        F.count_if("paid").alias("cash_payments"),
        F.count_if(~F.col("paid")).alias("sessions"),
    )
    return totals.withColumn("pace", F.col("cash_cents") / goal_cents)


def sync_health(sync_log: DataFrame, now: datetime, stale_days: int = 5) -> DataFrame:
    """One row: counts by action, latest timestamp, and whether it is stale."""
    return sync_log.agg(
        F.count_if(F.col("action") == "insert").alias("applied"),
        F.count_if(F.col("action") == "skip").alias("skipped"),
        F.count_if(F.col("device_id").isNull()).alias("quarantined"),
        F.max("server_timestamp").alias("latest"),
    ).withColumn("stale", F.coalesce(F.col("latest") < _moment(now - timedelta(days=stale_days)), F.lit(True)))
