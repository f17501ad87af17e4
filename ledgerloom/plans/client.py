"""Client-side aggregates, set operations and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import actions, client, ledger, records
from ledgerloom.plans.registry import query
from ledgerloom.sources.adapter import raw, table


def _draws(spark, d):
    """Draws of entitlements: all purchases; a tenth of them replays another's client id."""
    n = 400
    replayed = F.floor(F.col("event_id") / n) % 10 == 9
    client = F.col("event_id") - F.when(replayed, n).otherwise(0)
    return raw(spark, d, "events").where("event_type = 'purchase'").select(
        (F.col("event_id") % n).alias("entitlement_id"),
        F.concat(F.lit("d"), F.lpad(client.cast("string"), 12, "0")).alias("client_id"),
        F.col("ts").alias("created_at"),
        F.floor("value").alias("amount"),
    )


DRAWS_SQL = """select event_id % 400 as entitlement_id,
                      'd' || lpad(cast(event_id - case when event_id // 400 % 10 = 9 then 400 else 0 end as varchar), 12, '0') as client_id,
                      ts as created_at, cast(floor(value) as bigint) as amount from events where event_type = 'purchase'"""


@query(f"""with recursive draws as ({DRAWS_SQL}),
    once as (select entitlement_id, client_id, min(created_at) as created_at, arg_min(amount, created_at) as amount
             from draws group by 1, 2),
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
    select id as entitlement_id, remaining as remaining_units, applied, rejected from fold
    qualify row_number() over (partition by id order by k desc) = 1""")
def draws_fold(spark, d):
    balances = table(spark, d, "entitlements").select(F.col("id").alias("entitlement_id"), "remaining_units")
    return ledger.fold_draws(balances, _draws(spark, d))


@query(f"""with draws as ({DRAWS_SQL}),
    waiting as (select entitlement_id, sum(amount)::bigint as pending from draws group by 1)
    select e.id, e.player_id, coalesce(w.pending, 0) as pending,
           e.remaining_units - coalesce(w.pending, 0) as optimistic_units,
           e.status = 'active' and (e.remaining_units is null or e.remaining_units - coalesce(w.pending, 0) > 0) as can_draw
    from entitlements e left join waiting w on w.entitlement_id = e.id""")
def pending_draw_balance(spark, d):
    return ledger.pending_balances(table(spark, d, "entitlements"), _draws(spark, d))


@query("""select e.event_id as id, case when floor(e.value) <= 0 then 'invalid_amount' when t.id is null then 'not_found'
                 when t.status <> 'active' then 'inactive' when t.remaining_units < floor(e.value) then 'insufficient_units' end as reason
          from events e left join entitlements t on t.id = e.event_id * 2 where e.event_type = 'purchase'""")
def draw_reasons(spark, d):
    e = raw(spark, d, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), (F.col("event_id") * 2).alias("_e"), F.floor("value").alias("amount")
    )
    t = table(spark, d, "entitlements").select(F.col("id").alias("_e"), "status", "remaining_units", F.lit(True).alias("_found"))
    reason = ledger.draw_reason(F.col("amount"), F.coalesce("_found", F.lit(False)), F.col("status"), F.col("remaining_units"))
    return e.join(t, "_e", "left").select("id", reason.alias("reason"))


@query("""with local as (select p_partkey as id, 'local' as origin from part),
          server as (select id, 'server' as origin from players)
          select * from server union all select * from local where id not in (select id from server)""")
def local_not_in_roster(spark, d):
    local = raw(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("local").alias("origin"))
    server = table(spark, d, "players").select("id", F.lit("server").alias("origin"))
    return ledger.only_local(local, server, "id")


@query("""select o.o_orderkey as id, coalesce('s' || s.s_suppkey, 'l' || o.o_custkey) as player
          from orders o left join supplier s on s.s_suppkey = o.o_custkey""")
def local_id_rewrite(spark, d):
    rows = raw(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("l"), F.col("o_custkey").cast("string")).alias("player"))
    known = raw(spark, d, "supplier").select(
        F.concat(F.lit("l"), F.col("s_suppkey").cast("string")).alias("local_id"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("server_id"),
    )
    return ledger.resolve_ids(rows, "player", known)


@query("""select id, created_at, 'server' as origin from sessions
          union all select event_id, ts, 'local' from events""")
def history_union(spark, d):
    local = raw(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return client.with_origin(table(spark, d, "sessions").select("id", "created_at"), local)


@query("""select n_name as name from nation where n_nationkey not in (select distinct s_nationkey from supplier)""")
def missing_expected(spark, d):
    """Expected names that are not present."""
    present = raw(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return client.missing(raw(spark, d, "nation"), present, "n_nationkey").select(F.col("n_name").alias("name"))


@query("""select e.event_id as client_id, coalesce(r.status, 'unsynced') as status
          from events e left join (select o_orderkey as event_id, case o_orderstatus when 'F' then 'applied' when 'O' then 'skipped' else 'rejected' end as status
                                   from orders) r using (event_id)""")
def match_sync_results(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderstatus") == "O", "skipped").otherwise("rejected")
    got = raw(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), kind.alias("status"))
    return ledger.sync_statuses(raw(spark, d, "events").select("event_id"), got, "event_id").withColumnRenamed("event_id", "client_id")


@query("""with s as (select c_custkey as id from customer), o as (select p_partkey as id, p_name from part)
          select coalesce(s.id, o.id)::varchar as custom_id, s.id as ord, o.p_name as content,
                 case when s.id is null then 'stray' when o.id is null then 'missing' else 'answered' end as state
          from s full join o on o.id = s.id""")
def batch_outputs_in_order(spark, d):
    asked = raw(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("custom_id"), F.col("c_custkey").alias("ord"))
    out = raw(spark, d, "part").select(F.col("p_partkey").cast("string").alias("custom_id"), F.col("p_name").alias("content"))
    return ledger.outputs_in_order(asked, out).orderBy(F.asc_nulls_last("ord"), "custom_id")


@query("""select id, name, row_number() over (order by id desc) as k from players p join (select id as i, first_name || ' ' || last_name as name from players) on i = id
          order by id desc limit 5""")
def recent_players(spark, d):
    """The five latest players; the limit is the feature."""
    top = table(spark, d, "players").select("id", F.concat_ws(" ", "first_name", "last_name").alias("name")).orderBy(F.desc("id")).limit(5)
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("id"))).cast("long"))


@query("""select o_custkey as player_id, list_sort(list(distinct o_orderpriority))[:4] as members from orders group by 1""")
def subscription_members(spark, d):
    """Distinct members, at most four."""
    return raw(spark, d, "orders").groupBy(F.col("o_custkey").alias("player_id")).agg(
        F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 4).alias("members")
    )


@query("""select a.id, a.session_id, case when s.id is null then 'session_required' when s.player_id <> a.player_id then 'session_player_mismatch' end as reason
          from (select event_id as id, event_id + 1 as session_id, user_id as player_id from events where event_type = 'error') a
          left join sessions s on s.id = a.session_id""")
def attendance_consistency(spark, d):
    a = raw(spark, d, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("id"), (F.col("event_id") + 1).alias("session_id"), F.col("user_id").alias("player_id")
    )
    s = table(spark, d, "sessions").select(F.col("id").alias("session_id"), F.col("player_id").alias("_p"))
    reason = F.when(F.col("_p").isNull(), "session_required").when(F.col("_p") != F.col("player_id"), "session_player_mismatch")
    return a.join(s, "session_id", "left").select("id", "session_id", reason.alias("reason"))


@query("""select p.id, p.first_name || ' ' || p.last_name as name, b.units as units, v.last_visit
          from players p
          left join (select player_id, sum(remaining_units)::bigint as units from entitlements where status = 'active' group by 1) b on b.player_id = p.id
          left join (select player_id, max(coalesce(started_at, created_at)::date) as last_visit from sessions group by 1) v on v.player_id = p.id""")
def roster_overview(spark, d):
    """Roster rows with summed balances and last visits."""
    p = table(spark, d, "players").select("id", F.concat_ws(" ", "first_name", "last_name").alias("name"))
    return client.overview(p, table(spark, d, "entitlements"), table(spark, d, "sessions"))


@query("""select event_id as id, case when event_id % 13 = 0 then 'quarantined' when event_id % 4 in (0, 1) then 'unsynced' else 'done' end as queue
          from events where user_id % 2 = 0 or event_id % 13 = 0""")
def queue_by_owner(spark, d):
    """Queue items of the current owner; items without an owner are quarantined."""
    k = F.col("event_id")
    items = raw(spark, d, "events").select(
        k.alias("id"), F.when(k % 13 != 0, F.col("user_id") % 2).alias("owner"), F.when((k % 4).isin(0, 1), "unsynced").otherwise("done").alias("status")
    )
    return client.queue_of(items, F.lit(0)).select("id", F.col("status").alias("queue"))


@query("""select event_id as id, case event_type when 'click' then 'session' when 'purchase' then 'payment' else 'other' end as entity
          from events where (user_id = 8 or json_extract(props, '$.k')::bigint = 8) and event_id % 4 in (0, 1)""")
def player_local_actions(spark, d):
    """Unsynced actions of a player by mirrored id or by the payload's."""
    kind = F.when(F.col("event_type") == "click", "session").when(F.col("event_type") == "purchase", "payment").otherwise("other")
    queued = raw(spark, d, "events").select(
        F.col("event_id").alias("id"), kind.alias("entity"), F.col("user_id").alias("player_id"),
        F.get_json_object("props", "$.k").cast("long").alias("payload_player_id"), (F.col("event_id") % 4).isin(0, 1).alias("unsynced"),
    )
    return client.local_actions(queued, F.lit(8)).select("id", "entity")


@query("""select s.location_id, s.cents is not distinct from c.cents as same
          from (select location_id, sum(amount_cents)::bigint as cents from payments group by 1) s
          left join (select location_id, sum(amount_cents)::bigint as cents from payments where location_id <> 2 group by 1) c using (location_id)""")
def summaries_equal(spark, d):
    """Does a cached summary equal the fresh one?"""
    p = table(spark, d, "payments")
    total = lambda df: df.groupBy("location_id").agg(F.sum("amount_cents").alias("cents"))
    return client.same_totals(total(p), total(p.where("location_id <> 2")), "location_id", "cents")


@query("""select user_id, max(greatest(ts, ts + interval 1 minute * (event_id % 3))) as latest from events group by user_id""")
def latest_timestamp(spark, d):
    later = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 3).cast("int"))
    return raw(spark, d, "events").groupBy("user_id").agg(F.max(F.greatest("ts", later)).alias("latest"))


@query("""select 'Prices: ' || string_agg(type || ' from R' || (cents // 100), '; ' order by type) as prompt
          from (select type, min(price_cents) as cents from products group by type)""")
def pricing_prompt(spark, d):
    """The price list as one line of text for a model's instructions."""
    least = table(spark, d, "products").groupBy("type").agg(F.min("price_cents").alias("cents"))
    line = F.struct("type", F.concat(F.col("type"), F.lit(" from R"), F.floor(F.col("cents") / 100).cast("string")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return least.agg(F.concat(F.lit("Prices: "), F.array_join(lines, "; ")).alias("prompt"))


@query("""select s.id, s.name, coalesce(b.present, false) as present from (select id, first_name || ' ' || last_name as name from players) s
          left join (select user_id as id, bool_or(event_id % 2 = 0) as present from events group by 1) b using (id)""")
def attendance_roster(spark, d):
    """Marks of the roster before are kept for the players who are still there."""
    before = raw(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 2 == 0).alias("present"))
    return client.attendance_roster(table(spark, d, "players").select("id", F.concat_ws(" ", "first_name", "last_name").alias("name")), before)


@query("""with puts as (select user_id as device_id, case event_id % 3 when 0 then 'session' when 1 then 'session_owner' else 'last_sync' end as key,
                               'v' || event_id % 4 as value, event_id as seq from events),
               stored as (select c_custkey as device_id, 'device_id' as key, c_name as value from customer
                          union all select c_custkey, 'session_owner', 'v0' from customer where c_custkey % 2 = 0),
               new as (select device_id, key, arg_max(value, seq) as value from puts group by 1, 2),
               merged as (select device_id, key, coalesce(n.value, s.value) as value from stored s full join new n using (device_id, key)),
               gone as (select c_custkey as device_id from customer c left join merged o on o.device_id = c_custkey and o.key = 'session_owner'
                        where o.value is not distinct from case when c_custkey % 3 <> 0 then 'v0' end)
          select * from merged m where not (key in ('session', 'session_owner') and device_id in (select device_id from gone))""")
def client_metadata(spark, d):
    """Puts by key, then sign-outs that hold only where the owner is the expected one."""
    e, c = raw(spark, d, "events"), raw(spark, d, "customer")
    third = F.col("event_id") % 3
    puts = e.select(
        F.col("user_id").alias("device_id"), F.when(third == 0, "session").when(third == 1, "session_owner").otherwise("last_sync").alias("key"),
        F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")).alias("value"), F.col("event_id").alias("seq"),
    )
    device = F.col("c_custkey").alias("device_id")
    stored = c.select(device, F.lit("device_id").alias("key"), F.col("c_name").alias("value")).unionByName(
        c.where("c_custkey % 2 = 0").select(device, F.lit("session_owner").alias("key"), F.lit("v0").alias("value"))
    )
    out = c.select(device, F.when(F.col("c_custkey") % 3 != 0, "v0").alias("expected_owner"))
    return client.delete_if_owned(client.put_values(stored, puts), out, "session_owner", ["session", "session_owner"])


@query("""select user_id as device_id, coalesce(c_name, 'new-' || user_id) as id from (select distinct user_id from events)
          left join (select c_custkey, c_name from customer where c_custkey % 2 = 0) on c_custkey = user_id""")
def device_ids(spark, d):
    """An install keeps its stored id, or takes a new one."""
    installs = raw(spark, d, "events").select(F.col("user_id").alias("device_id")).distinct()
    fresh = installs.withColumn("fresh", F.concat(F.lit("new-"), F.col("device_id").cast("string")))
    stored = raw(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("device_id"), F.lit("device_id").alias("key"), F.col("c_name").alias("value"))
    return client.device_ids(fresh, stored)


@query("""select c_custkey as id, c_name as name, case when c_custkey % 3 <> 0 then '0' || c_custkey end as phone,
                 case when c_custkey % 3 <> 0 then 2 else 1 end as fields from customer""")
def registration_fields(spark, d):
    """Of a registration only the name and a filled guardian's phone are kept."""
    phone = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("0"), F.col("c_custkey").cast("string")))
    kept = client.personal_fields(F.concat(F.lit(" "), F.col("c_name"), F.lit("  ")), phone)
    rows = raw(spark, d, "customer").select(F.col("c_custkey").alias("id"), kept.alias("_m"))
    at = lambda n: F.try_element_at("_m", F.lit(n))
    return rows.select("id", at("name").alias("name"), at("guardian_phone").alias("phone"), F.size("_m").alias("fields"))


@query("""select event_id as id, case when event_type = 'purchase' then case when event_id % 3 = 0 then '77' else (case when event_id % 2 = 0 then 3000 else 3050 end)::varchar end end as amount_cents,
                 'x' || event_id as value from events""")
def normalized_payloads(spark, d):
    """Payments get the cents of their amount unless they have cents; other payloads stay."""
    k = F.col("event_id")
    body = actions.payload(amount=F.when(k % 2 == 0, "R30").otherwise("30.50"), value=F.concat(F.lit("x"), k.cast("string")), amount_cents=F.when((k % 3 == 0) & (F.col("event_type") == "purchase"), F.lit(77)))
    entity = F.when(F.col("event_type") == "purchase", "payment").otherwise("student_metrics")
    known = F.array(F.lit(3000).cast("long"))
    rows = raw(spark, d, "events").select(k.alias("id"), actions.normalized_payload(entity, body, known).alias("_m"))
    return rows.select("id", F.try_element_at("_m", F.lit("amount_cents")).alias("amount_cents"), F.try_element_at("_m", F.lit("value")).alias("value"))


@query("""select n_name as name from nation union select r_name from region""")
def school_names(spark, d):
    """Partner and proposed names, each once."""
    return records.distinct_names(raw(spark, d, "nation").select(F.col("n_name").alias("name")), raw(spark, d, "region").select(F.col("r_name").alias("name")))


@query(f"""with recursive draws as ({DRAWS_SQL}),
    first as (select *, row_number() over (partition by entitlement_id, client_id order by created_at, amount) = 1 as f from draws),
    queue as (select *, created_at::date - cast(isodow_ as integer) as period, row_number() over (partition by entitlement_id order by created_at, client_id) as k
              from (select *, (isodow(created_at) - 1)::bigint as isodow_ from first where f and amount > 0)),
    fold as (
        select id, remaining_units as remaining, valid_from as since, null::varchar as status, 0::bigint as k from entitlements where status = 'active'
        union all
        select g.id, case when g.start is null or g.start < g.amount then g.start else g.start - g.amount end, greatest(g.since, g.period),
               case when g.start is null or g.start >= g.amount then 'applied' else 'rejected' end, g.k
        from (select f.id, f.since, q.period, q.amount, q.k, case when q.period > f.since then 120 else f.remaining end as start
              from fold f join queue q on q.entitlement_id = f.id and q.k = f.k + 1) g)
    select id as entitlement_id, count(*) filter (status = 'applied') as applied, count(*) filter (status = 'rejected') as rejected,
           arg_max(coalesce(remaining, -1), k) as remaining
    from fold where k > 0 group by 1""")
def draws_with_reset(spark, d):
    """Draws of active weekly entitlements, whose units come back each Monday."""
    rules = F.create_map(F.lit("reset"), F.lit("monday"), F.lit("hours_per_week"), F.lit("2"))
    e = table(spark, d, "entitlements").select(F.col("id").alias("entitlement_id"), "remaining_units", "status", "valid_from", rules.alias("rules"))
    told = ledger.draw_results(e.where("status = 'active'"), _draws(spark, d)).where("status <> 'skipped' and coalesce(reason, '') not in ('not_found', 'invalid_amount')")
    return told.groupBy("entitlement_id").agg(
        F.count_if(F.col("status") == "applied").alias("applied"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.max_by(F.coalesce("remaining", F.lit(-1)), F.struct("created_at", "client_id")).alias("remaining"),
    )
