"""Streaming queries, compared with their batch oracles."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ledgerloom.plans.client import DRAWS_SQL, _draws
from ledgerloom.plans.loading import LWW_SQL
from ledgerloom.plans.registry import query
from ledgerloom.sources.adapter import raw, table
from ledgerloom.operators.scope import Scope
from ledgerloom.sources.shared import shared_folder
from ledgerloom.streaming import actions, sync


@query(LWW_SQL.format(where="").replace(", count(*) as n_edits", ""))
def sync_stream(spark, d):
    """Edits streamed in four out-of-order batches end in the batch answer."""
    edits = table(spark, d, "edits").repartition(4, F.col("seq") % 4)
    return sync.sync_edits(edits, "natural_key", ["value"])


@query(f"""with recursive draws as ({DRAWS_SQL}),
    once as (select entitlement_id, client_id, min(created_at) as created_at, arg_min(amount, created_at) as amount from draws group by 1, 2),
    queue as (select *, row_number() over (partition by entitlement_id order by created_at, client_id) as k from once),
    fold as (
        select id, remaining_units as remaining, 0 as applied, 0 as rejected, 0::bigint as k from entitlements
        union all
        select f.id,
               case when q.amount > 0 and (f.remaining is null or f.remaining >= q.amount) then f.remaining - q.amount else f.remaining end,
               case when q.amount > 0 and (f.remaining is null or f.remaining >= q.amount) then f.applied + 1 else f.applied end,
               case when q.amount > 0 and (f.remaining is null or f.remaining >= q.amount) then f.rejected else f.rejected + 1 end,
               q.k
        from fold f join queue q on q.entitlement_id = f.id and q.k = f.k + 1)
    select id as entitlement_id, applied, rejected from fold
    qualify row_number() over (partition by id order by k desc) = 1 and k > 0""")
def stateful_draws(spark, d):
    """Draws through the stateful stream: results counted per entitlement."""
    e = table(spark, d, "entitlements").select(F.col("id").alias("entitlement_id"), F.col("remaining_units").alias("start_units"))
    out = sync.stateful_draws(_draws(spark, d).join(e, "entitlement_id"))
    return out.groupBy("entitlement_id").agg(
        F.count_if(F.col("status") == "applied").cast("int").alias("applied"),
        F.count_if(F.col("status") == "rejected").cast("int").alias("rejected"),
    )


STREAM_DRAWS_SQL = """select event_id // 20 as entitlement_id,
                             case when event_id % 23 <> 0 then 'd' || (case when event_id % 10 = 9 then event_id - 3 else event_id end) end as client_id,
                             ts as created_at, cast(floor(value) as bigint) % 40 - 2 as amount, event_id % 17 <> 0 as signed from events"""


@query(f"""with recursive draws as ({STREAM_DRAWS_SQL}),
    first as (select *, client_id is null or row_number() over (partition by entitlement_id, client_id order by created_at, amount) = 1 as f from draws),
    queue as (select *, created_at::date - cast(isodow(created_at) - 1 as integer) as period,
                     row_number() over (partition by entitlement_id order by created_at, client_id nulls last, amount) as k from first),
    fold as (
        select id, e.status = 'active' as active, remaining_units as remaining, valid_from as since, null::varchar as client_id, null::timestamp as created_at,
               null::varchar as status, null::varchar as reason, null::varchar as audit, 0::bigint as k from entitlements e
        union all
        select id, active, case when took then start - amount else start end, case when counts then greatest(since, period) else since end, client_id, created_at,
               case when amount <= 0 then 'rejected' when not f then 'skipped' when not active or start < amount or (start is not null and not signed) then 'rejected' else 'applied' end,
               case when amount <= 0 then 'invalid_amount' when not f then null when not active then 'inactive' when start < amount then 'insufficient_units'
                    when start is not null and not signed then 'signature_failed' end,
               case when amount <= 0 then null when not f then 'skip' when not active then null when start is null then 'skip' when took then 'update' end, k
        from (select *, coalesce(counts and active and signed and start >= amount, false) as took
              from (select g.id, g.active, g.since, q.period, q.amount, q.f, q.signed, q.client_id, q.created_at, q.k, q.f and q.amount > 0 as counts,
                           case when q.f and q.amount > 0 and q.period > g.since then 120 else g.remaining end as start
                    from fold g join queue q on q.entitlement_id = g.id and q.k = g.k + 1)))
    select id as entitlement_id, client_id, created_at, status, reason, remaining, audit from fold where k > 0
    union all
    select entitlement_id, client_id, created_at, 'rejected', case when amount <= 0 then 'invalid_amount' else 'not_found' end, null, null
    from draws where entitlement_id not in (select id from entitlements)""")
def stream_draw_results(spark, d):
    """Draws of weekly entitlements as a stream: a result for each, with reason and signature.

    Some draws have no client id, some repeat another's, some can't be signed.
    """
    rules = F.create_map(F.lit("reset"), F.lit("monday"), F.lit("hours_per_week"), F.lit("2"))
    e = table(spark, d, "entitlements").select(F.col("id").alias("entitlement_id"), "remaining_units", "status", "valid_from", rules.alias("rules"))
    k = F.col("event_id")
    draws = raw(spark, d, "events").select(
        F.floor(k / 20).alias("entitlement_id"),
        F.when(k % 23 != 0, F.concat(F.lit("d"), F.when(k % 10 == 9, k - 3).otherwise(k).cast("string"))).alias("client_id"),
        F.col("ts").alias("created_at"), (F.floor("value") % 40 - 2).alias("amount"), (k % 17 != 0).alias("signed"),
    )
    return sync.stream_draws(e, draws)


@query("""with log as (select device_id, server_timestamp as seen from sync_log where device_id is not null)
          select device_id, date_trunc('milliseconds', max(seen)) as last_sync from log group by 1 having max(seen) + interval 36 hour <= (select max(seen) from log)""")
def stale_device_stream(spark, d):
    """Devices whose last sync lies 36 hours back, told by a timer on the log's own time."""
    log = table(spark, d, "sync_log").select("device_id", "server_timestamp")
    return sync.stale_devices(log, after=timedelta(hours=36))


def _tables(spark, d, scope):
    nothing = spark.createDataFrame([], "id long, rules map<string,string>")
    tables = actions.ActionTables(spark, shared_folder(spark, "actions"), scope, nothing, F.array(F.lit(3000).cast("long")))
    tables.seed(table(spark, d, "players").drop("active"))
    return tables


def _action(client, entity, at, **fields):
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()]
    body = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    return [client.alias("client_id"), F.lit(entity).alias("entity"), body.alias("payload"), at.cast("timestamp").alias("created_at")]


@query("""with e as (select event_id, user_id from events where event_type in ('view', 'click')),
               p as (select c_custkey as id, c_custkey % 10 = 0 as nameless from customer)
          select 'p' || id as client_id, 'player' as entity, case when nameless then 'rejected' else 'applied' end as status,
                 case when nameless then 'unresolved_player' end as reason, 2 as batch from p
          union all
          select k || event_id, case k when 's' then 'session' else 'attendance' end, case when nameless then 'rejected' else 'applied' end,
                 case when nameless then 'producer_rejected' end, 2
          from e join p on id = user_id, (values ('s'), ('a')) v(k)""")
def two_phase_flush(spark, d):
    """Attendances, then their sessions, then their players, each a batch later: all wait for
    the players, and those of a player that is rejected are rejected with it."""
    scope = Scope("manager", 1)
    tables = _tables(spark, d, scope)
    e = raw(spark, d, "events").where("event_type in ('view', 'click')")
    k, player, at = F.col("event_id").cast("string"), F.concat(F.lit("p"), F.col("user_id").cast("string")), F.col("ts")
    session = F.concat(F.lit("s"), k)
    attends = e.select(*_action(F.concat(F.lit("a"), k), "attendance", at, player_id=player, session_id=session, attendance_date=F.to_date("ts")))
    sessions = e.select(*_action(session, "session", at, player_id=player, session_type=F.lit("kit"), started_at=k, ended_at=k))
    c = F.col("c_custkey")
    name = lambda v: F.when(c % 10 != 0, v)
    players = raw(spark, d, "customer").select(
        *_action(F.concat(F.lit("p"), c.cast("string")), "player", F.lit("2024-01-01"), first_name=name(F.concat(F.lit("F"), c.cast("string"))), last_name=name(F.col("c_name")))
    )
    folder = shared_folder(spark, "flush")
    for wave in (attends, sessions, players):
        out = actions.sync_actions(tables, wave, folder)
    return out.select("client_id", "entity", "status", "reason", F.col("batch").cast("int").alias("batch"))


@query("""with sent as (
            select event_id as k, event_type as t, p.id is not null as found, p.location_id = 1 as own, copy
            from events left join players p on p.id = case when event_type = 'signup' and event_id % 6 = 0 then -1 else user_id end,
                 (values (1), (2)) v(copy) where copy = 1 or event_id % 9 = 0),
          judged as (
            select *, case when t not in ('purchase', 'click', 'view', 'signup') then 'unknown_entity'
                           when t = 'view' and k % 11 = 0 then 'player_required' when not found then 'player_not_found' when not own then 'out_of_scope'
                           when t = 'purchase' and k % 3 = 2 then 'bad_amount' when t = 'view' and k % 4 = 0 then 'invalid_metric_type'
                           when t = 'view' and k % 5 = 0 then 'value_required' when t = 'signup' and k % 4 = 0 then 'consent_type_required' end as reason
            from sent)
          select 'e' || k as client_id, case t when 'purchase' then 'payment' when 'click' then 'session' when 'view' then 'student_metrics' when 'signup' then 'consent' else 'invoice' end as entity,
                 case when reason is not null then 'rejected' when copy = 1 then 'applied' else 'skipped' end as status, reason
          from judged""")
def apply_batch_results(spark, d):
    """One batch of all entities from a manager's device, some sent twice: a result for each."""
    scope = Scope("manager", 1)
    tables = _tables(spark, d, scope)
    e, k, u = raw(spark, d, "events"), F.col("event_id"), F.col("user_id")
    t, text_k = F.col("event_type"), F.col("event_id").cast("string")
    when = lambda kind, v: F.when(t == kind, v)
    entity = F.coalesce(when("purchase", F.lit("payment")), when("click", F.lit("session")), when("view", F.lit("student_metrics")), when("signup", F.lit("consent")), F.lit("invoice"))
    player = F.when((t == "view") & (k % 11 == 0), None).when((t == "signup") & (k % 6 == 0), k + 10**12).otherwise(u)
    parts = _action(
        F.concat(F.lit("e"), text_k), "", F.col("ts"), player_id=player,
        amount=when("purchase", F.element_at(F.array(F.lit("R30"), F.lit("45.5"), F.lit("x")), (k % 3 + 1).cast("int"))), paid_at=when("purchase", k),
        session_type=when("click", F.lit("kit")), started_at=when("click", k), ended_at=when("click", k),
        metric_type=when("view", F.when(k % 4 == 0, "mood").otherwise("typing_wpm")), value=when("view", F.when(k % 5 != 0, k)), measured_at=when("view", k),
        consent_type=when("signup", F.when(k % 4 == 0, "").otherwise("photo")),
    )
    once = e.select(parts[0], entity.alias("entity"), *parts[2:], (k % 9 == 0).alias("_twice"))
    sent = once.unionByName(once.where("_twice")).drop("_twice")
    return actions.sync_actions(tables, sent, shared_folder(spark, "batch")).select("client_id", "entity", "status", "reason")
