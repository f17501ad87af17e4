"""Captures as actions, reasons to reject actions, users and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import to_cents
from ledgerloom.functions.text import METRIC_TYPES, day_of
from ledgerloom.operators.scope import Scope
from ledgerloom.sources.shared import written

PRODUCERS = ("player", "session")
ACTION = "struct<client_id:string,entity:string,payload:map<string,string>>"


def payload(**fields: Column) -> Column:
    """A payload without the fields that are null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def action(client_id: Column, entity: str, body: Column) -> Column:
    return F.struct(client_id.alias("client_id"), F.lit(entity).alias("entity"), body.alias("payload"))


def _exploded(captures: DataFrame, actions: Column) -> DataFrame:
    each = captures.select(F.col("now").alias("created_at"), F.posexplode(actions).alias("pos", "_a"))
    return each.select("created_at", "pos", "_a.client_id", "_a.entity", "_a.payload", day_of(F.col("created_at")).alias("day"))


def session_actions(captures: DataFrame) -> DataFrame:
    """A lounge session and its cash payment or its draw.

    ``captures``: capture_id, now (ISO), ended_at, player_id, console, minutes,
    amount_cents (null for a draw), entitlement_id.  Cash carries no product.
    """
    c = F.col
    session = payload(player_id=c("player_id"), session_type=F.lit("lounge"), started_at=c("now"), ended_at=c("ended_at"), duration_minutes=c("minutes"), reference=c("console"))
    cash = payload(player_id=c("player_id"), amount_cents=c("amount_cents"), method=F.lit("cash"), paid_at=c("now"))
    draw = payload(entitlement_id=c("entitlement_id"), amount=c("minutes"))
    second = F.concat(c("capture_id"), F.lit("-2"))
    leg = F.when(c("amount_cents").isNotNull(), action(second, "payment", cash)).otherwise(action(second, "entitlement", draw))
    return _exploded(captures, F.array(action(F.concat(c("capture_id"), F.lit("-1")), "session", session), leg))


def attendance_actions(captures: DataFrame) -> DataFrame:
    """A session and an attendance for every member who is present.

    ``captures``: capture_id, now, session_type, reference, school_id, roster
    (array of struct player_id, present).
    """
    present = F.filter("roster", lambda m: m["present"])
    pairs = F.transform(
        present,
        lambda m, i: F.array(
            action(
                F.concat(F.col("capture_id"), F.lit("-s"), i.cast("string")), "session",
                payload(player_id=m["player_id"], session_type=F.col("session_type"), started_at=F.col("now"), ended_at=F.col("now"), duration_minutes=F.lit(0), reference=F.col("reference"), school_id=F.col("school_id")),
            ),
            action(
                F.concat(F.col("capture_id"), F.lit("-a"), i.cast("string")), "attendance",
                payload(session_id=F.concat(F.col("capture_id"), F.lit("-s"), i.cast("string")), player_id=m["player_id"], attendance_date=day_of(F.col("now")), present=F.lit("true"), school_id=F.col("school_id")),
            ),
        ),
    )
    return _exploded(captures, F.flatten(pairs))


def sale_actions(captures: DataFrame, most_members: int = 4) -> DataFrame:
    """A payment, and an entitlement for each recipient of a subscription or pass.

    ``captures``: capture_id, now, kind, player_id, product_id, price_cents, members.
    A subscription goes to its first distinct members, a pass to the buyer.
    """
    c = F.col
    paid = payload(player_id=c("player_id"), product_id=c("product_id"), amount_cents=c("price_cents"), method=F.lit("cash"), paid_at=c("now"))
    who = (
        F.when(c("product_id").isNull(), F.array().cast("array<string>"))
        .when(c("kind") == "subscription", F.slice(F.array_distinct("members"), 1, most_members))
        .when(c("kind") == "once_off_pass", F.array("player_id"))
        .otherwise(F.array().cast("array<string>"))
    )
    given = F.transform(
        who, lambda m, i: action(F.concat(c("capture_id"), F.lit("-e"), i.cast("string")), "entitlement", payload(player_id=m, product_id=c("product_id")))
    )
    return _exploded(captures, F.concat(F.array(action(F.concat(c("capture_id"), F.lit("-p")), "payment", paid)), given))


def normalized_payload(entity: Column, body: Column, known_cents: Column) -> Column:
    """A payload before it is keyed: a payment without amount_cents takes the cents of its amount.

    Payloads are maps of texts, so a metric's value is a text already.
    """
    given = F.coalesce(F.map_contains_key(body, "amount_cents") & F.try_element_at(body, F.lit("amount_cents")).isNotNull(), F.lit(False))
    cents = to_cents(F.try_element_at(body, F.lit("amount")), known_cents).cast("string")
    without = F.map_filter(body, lambda k, _: k != "amount_cents")
    return F.when((entity == "payment") & ~given, F.map_concat(without, F.create_map(F.lit("amount_cents"), cents))).otherwise(body)


def in_sync_order(actions: DataFrame) -> DataFrame:
    """Producers of ids first, then by time and client id."""
    return actions.orderBy((~F.col("entity").isin(*PRODUCERS)).cast("int"), "created_at", "client_id")


def action_reasons(actions: DataFrame, scope: Scope) -> DataFrame:
    """Actions with the first reason to reject them, null if none.

    ``actions`` has entity, payload (map), and what its references resolved to:
    location_id, school_id, session_player.
    """
    p = lambda name: F.try_element_at("payload", F.lit(name))
    entity, e = F.col("entity"), lambda *names: F.col("entity").isin(*names)
    natural = e("session", "attendance", "payment", "student_metrics")
    out_of_scope = ~scope.may_write(F.col("location_id"), F.col("school_id"))
    attends = e("attendance")
    reason = (
        F.when((entity == "player") & p("location_id").isNull() & F.lit(scope.unrestricted), "location_required")
        .when((entity == "consent") & p("player_id").isNull(), "player_required")
        .when((entity == "entitlement") & p("entitlement_id").isNull() & (p("player_id").isNull() | p("product_id").isNull()), "player_and_product_required")
        .when(natural & p("player_id").isNull(), "player_required")
        .when(out_of_scope, "out_of_scope")
        .when((entity == "consent") & (F.coalesce(p("consent_type"), F.lit("")) == ""), "consent_type_required")
        .when(attends & p("session_id").isNull() & F.lit(scope.role == "facilitator"), "session_required")
        .when(attends & p("session_id").isNotNull() & ~F.col("session_player").eqNullSafe(p("player_id")), "session_player_mismatch")
        .when((entity == "payment") & p("amount_cents").isNull(), "bad_amount")
        .when((entity == "student_metrics") & ~F.coalesce(p("metric_type").isin(*METRIC_TYPES), F.lit(False)), "invalid_metric_type")
        .when((entity == "student_metrics") & p("value").isNull(), "value_required")
    )
    return actions.withColumn("reason", reason)


def lookup_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """The one user that each identifier names, by exact name or e-mail, else in any
    case; null where none or several fit.  ``requests`` has identifier."""
    asked = requests.select("identifier", F.trim("identifier").alias("_k")).where(F.length("_k") > 0)
    keys = users.select("id", F.explode(F.array_distinct(F.array_compact(F.array("name", "email")))).alias("_key"))

    def found(key: Column, wanted: Column, name: str) -> DataFrame:
        hits = asked.select("identifier", wanted.alias("_w")).join(keys.select("id", key.alias("_w")), "_w")
        return hits.groupBy("identifier").agg(F.count_distinct("id").alias(f"{name}_n"), F.min("id").alias(f"{name}_id"))

    exact = found(F.col("_key"), F.col("_k"), "exact")
    loose = found(F.lower("_key"), F.lower("_k"), "loose")
    n, i = F.col("exact_n"), F.col("exact_id")
    chosen = F.when(n == 1, i).when(n.isNull() & (F.col("loose_n") == 1), F.col("loose_id"))
    return requests.join(exact, "identifier", "left").join(loose, "identifier", "left").select("identifier", chosen.alias("user_id"))


def reachable_roles(grants: DataFrame) -> DataFrame:
    """(member, role) of every role that a member holds directly or through others.

    A round joins the pairs that the last one found with all known ones, on either side,
    so a pair is met once as new and a chain needs as many rounds as the logarithm of
    its length; cycles end by themselves.  Each round's pairs are written out.
    """
    seen = new = written(grants.select("member", "role").where("member is not null and role is not null").distinct(), "roles")
    while True:
        onward = lambda df: df.select(F.col("member").alias("role"), F.col("role").alias("_next"))
        met = new.join(onward(seen), "role").unionByName(seen.join(onward(new), "role")).select("member", F.col("_next").alias("role"))
        new = written(met.distinct().join(seen, ["member", "role"], "left_anti"), "roles")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
