"""What a client holds: local and server rows together, queues, rosters, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to_null


def with_origin(server: DataFrame, local: DataFrame) -> DataFrame:
    """Rows of both sides, each with its origin; nothing is matched."""
    return server.withColumn("origin", F.lit("server")).unionByName(local.withColumn("origin", F.lit("local")))


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected rows whose key is not among those present."""
    return expected.join(present.select(key).distinct(), key, "left_anti")


def queue_of(items: DataFrame, owner: Column) -> DataFrame:
    """The owner's items as they are, and those without an owner as quarantined.

    ``items`` has owner and status; items of other owners stay out.
    """
    mine = items.where(F.col("owner").isNull() | (F.col("owner") == owner))
    return mine.withColumn("status", F.when(F.col("owner").isNull(), "quarantined").otherwise(F.col("status")))


def local_actions(actions: DataFrame, player: Column) -> DataFrame:
    """Unsynced actions of a player, named by the mirrored column or by the payload."""
    named = F.col("player_id").eqNullSafe(player) | F.col("payload_player_id").eqNullSafe(player)
    return actions.where(named & F.col("unsynced"))


def overview(players: DataFrame, entitlements: DataFrame, sessions: DataFrame) -> DataFrame:
    """Players (id, name) with units of active entitlements and the last visit."""
    units = entitlements.where("status = 'active'").groupBy(F.col("player_id").alias("id")).agg(F.sum("remaining_units").alias("units"))
    visit = F.max(F.to_date(F.coalesce("started_at", "created_at")))
    visits = sessions.groupBy(F.col("player_id").alias("id")).agg(visit.alias("last_visit"))
    return players.select("id", "name").join(units, "id", "left").join(visits, "id", "left")


def same_totals(fresh: DataFrame, cached: DataFrame, key: str, total: str) -> DataFrame:
    """Per key of the fresh summary: does the cached one say the same?"""
    was = cached.select(key, F.col(total).alias("_was"))
    return fresh.join(was, key, "left").select(key, F.col(total).eqNullSafe(F.col("_was")).alias("same"))


def first_by_title(rows: DataFrame, title: str, order: str, *columns: str) -> DataFrame:
    """The first row of each title, case and outer white space aside."""
    own = [F.min_by(c, order).alias(c) for c in columns]
    return rows.groupBy(F.lower(F.trim(title)).alias("slug")).agg(*own)


def attendance_roster(players: DataFrame, before: DataFrame) -> DataFrame:
    """The current players (id, name) with the marks of the roster before; new ones are absent."""
    marks = before.groupBy("id").agg(F.max("present").alias("_present"))
    return players.select("id", "name").join(marks, "id", "left").select(
        "id", "name", F.coalesce("_present", F.lit(False)).alias("present")
    )


def put_values(stored: DataFrame, puts: DataFrame, order: str = "seq") -> DataFrame:
    """(device_id, key, value) after the puts; the last put of a key wins."""
    keys = ["device_id", "key"]
    new = puts.groupBy(*keys).agg(F.max_by("value", order).alias("_new"), F.lit(True).alias("_put"))
    joined = stored.select(*keys, "value").join(new, keys, "full")
    return joined.select(*keys, F.when(F.col("_put"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def delete_if_owned(stored: DataFrame, deletes: DataFrame, owner_key: str, owned_keys: list[str]) -> DataFrame:
    """Metadata without the keys of devices whose owner is still the expected one.

    ``deletes`` has device_id and expected_owner.  A null expectation takes rows
    without an owner, never owned ones; an empty owner counts as none.
    """
    owner = stored.where(F.col("key") == owner_key).select("device_id", blank_to_null(F.col("value")).alias("_owner"))
    asked = deletes.select("device_id", blank_to_null(F.col("expected_owner")).alias("_expected")).distinct()
    held = asked.join(owner, "device_id", "left").where(F.col("_owner").eqNullSafe(F.col("_expected")))
    gone = held.select("device_id").distinct().withColumn("key", F.explode(F.array(*map(F.lit, owned_keys))))
    return stored.join(gone, ["device_id", "key"], "left_anti")


def device_ids(installs: DataFrame, stored: DataFrame) -> DataFrame:
    """Installs (device_id, fresh) with the id stored for each, or the fresh one where none is."""
    kept = stored.where("key = 'device_id'").select("device_id", blank_to_null(F.col("value")).alias("_kept"))
    return installs.join(kept, "device_id", "left").select("device_id", F.coalesce("_kept", "fresh").alias("id"))


def personal_fields(name: Column, guardian_phone: Column) -> Column:
    """The only personal fields that a registration keeps: name and, if filled, guardian_phone."""
    kept = F.array(
        F.struct(F.lit("name").alias("key"), F.trim(name).alias("value")),
        F.struct(F.lit("guardian_phone").alias("key"), guardian_phone.alias("value")),
    )
    return F.map_from_entries(F.filter(kept, lambda e: (e["key"] == "name") | (F.coalesce(F.length(e["value"]), F.lit(0)) > 0)))
