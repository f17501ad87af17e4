"""Reports, alerts, scoped reads and history."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerloom.operators import reports
from ledgerloom.operators.scope import Scope
from ledgerloom.plans.registry import query
from ledgerloom.sources.adapter import table

EVENTS_NOW = datetime(2024, 1, 31)
ORDERS_NOW = datetime(2001, 7, 15)
FOUNDER, MANAGER, FACILITATOR = Scope("founder"), Scope("manager", 1), Scope("facilitator", 1, 6)


def _revenue(spark, d, scope):
    return reports.revenue_summary(table(spark, d, "payments"), table(spark, d, "products"), table(spark, d, "players"), scope)


def _revenue_sql(where: str) -> str:
    return f"""
        select coalesce(sum(case when pr.type = 'pay_per_use' then amount_cents end), 0)::bigint as pay_per_use_cents,
               coalesce(sum(case when pr.type = 'subscription' then amount_cents end), 0)::bigint as subscription_cents,
               0::bigint as school_contracts_cents
        from payments pay join products pr on pr.id = pay.product_id join players pl on pl.id = pay.player_id
        where {where}"""


@query(_revenue_sql("true"))
def revenue_summary_founder(spark, d):
    return _revenue(spark, d, FOUNDER)


@query(_revenue_sql("pay.location_id = 1"))
def revenue_summary_manager(spark, d):
    return _revenue(spark, d, MANAGER)


@query(_revenue_sql("pay.location_id = 1 and pl.school_id = 6"))
def revenue_summary_facilitator(spark, d):
    return _revenue(spark, d, FACILITATOR)


@query("""select type, sum(amount_cents)::bigint as cents from payments join products on products.id = product_id group by type""")
def revenue_by_type(spark, d):
    return reports.revenue_by_type(table(spark, d, "payments"), table(spark, d, "products"))


@query(f"""with s as ({_revenue_sql("true")})
    select 'pay_per_use_cents' as stream, pay_per_use_cents as cents from s
    union all select 'subscription_cents', subscription_cents from s
    union all select 'school_contracts_cents', school_contracts_cents from s""")
def revenue_rows(spark, d):
    return reports.revenue_rows(_revenue(spark, d, FOUNDER))


@query("""select date_trunc('month', paid_on)::date as month, pay.location_id, type, sum(amount_cents)::bigint as cents,
                 count(*) as payments
          from payments pay join products on products.id = product_id group by 1, 2, 3""")
def revenue_by_period_ext(spark, d):
    """An extension: the report above by month and location."""
    kinds = table(spark, d, "products").select(F.col("id").alias("product_id"), "type")
    return (
        table(spark, d, "payments")
        .join(kinds, "product_id")
        .groupBy(F.trunc("paid_on", "month").alias("month"), "location_id", "type")
        .agg(F.sum("amount_cents").alias("cents"), F.count(F.lit(1)).alias("payments"))
    )


NO_SESSION_SQL = """
    select p.id from players p where active and {scope} and not exists (
        select 1 from sessions s where s.player_id = p.id
          and coalesce(s.started_at, s.created_at) >= timestamp '2024-01-24')"""


@query(NO_SESSION_SQL.format(scope="true"))
def alerts_no_recent_session(spark, d):
    return reports.without_recent_session(table(spark, d, "players"), table(spark, d, "sessions"), FOUNDER, EVENTS_NOW)


@query(NO_SESSION_SQL.format(scope="location_id = 1 and school_id = 6"))
def alerts_no_recent_session_facilitator(spark, d):
    return reports.without_recent_session(table(spark, d, "players"), table(spark, d, "sessions"), FACILITATOR, EVENTS_NOW)


@query("""select e.id from entitlements e join players p on p.id = e.player_id
          where e.status = 'active' and e.valid_to between date '2001-07-15' and date '2001-07-22' and e.location_id = 1""")
def alerts_entitlement_expiring(spark, d):
    return reports.expiring_entitlements(table(spark, d, "entitlements"), table(spark, d, "players"), MANAGER, ORDERS_NOW)


@query("""select e.id from entitlements e join products pr on pr.id = e.product_id join players p on p.id = e.player_id
          where e.status = 'active' and pr.type = 'subscription' and e.valid_to <= date '2001-07-15'""")
def alerts_subscription_due(spark, d):
    return reports.due_subscriptions(
        table(spark, d, "entitlements"), table(spark, d, "products"), table(spark, d, "players"), FOUNDER, ORDERS_NOW
    )


@query("""select device_id, max(server_timestamp) as last_sync from sync_log where device_id is not null
          group by device_id having max(server_timestamp) < timestamp '2024-01-26'""")
def alerts_unsynced_device(spark, d):
    return reports.unsynced_devices(table(spark, d, "sync_log"), FOUNDER, EVENTS_NOW)


@query(f"""
    select 1 as rule_no, 'no_recent_session' as alert, id::varchar as subject_id, 'no session in 7 days' as detail
    from ({NO_SESSION_SQL.format(scope="true")})
    union all
    select 2, 'entitlement_expiring', e.id::varchar, 'entitlement expiring within horizon'
    from entitlements e join players p on p.id = e.player_id
    where e.status = 'active' and e.valid_to between date '2024-01-31' and date '2024-02-07'
    union all
    select 3, 'subscription_due', e.id::varchar, 'subscription renewal due'
    from entitlements e join products pr on pr.id = e.product_id join players p on p.id = e.player_id
    where e.status = 'active' and pr.type = 'subscription' and e.valid_to <= date '2024-01-31'
    union all
    select 4, 'unsynced_device', device_id::varchar, 'device last sync > 5 days'
    from (select device_id from sync_log where device_id is not null group by device_id
          having max(server_timestamp) < timestamp '2024-01-26')""")
def alerts_all(spark, d):
    names = ("players", "entitlements", "sessions", "products", "sync_log")
    return reports.all_alerts({n: table(spark, d, n) for n in names}, FOUNDER, EVENTS_NOW).orderBy("rule_no", "subject_id")


@query("""select id, first_name || ' ' || last_name as name, school_id, location_id, active from players where location_id = 1""")
def roster_scoped(spark, d):
    return reports.roster(table(spark, d, "players"), MANAGER)


@query("""select id, first_name || ' ' || last_name as name, school_id, location_id, active from players
          where contains(lower(first_name || ' ' || last_name), 'hold n1')""")
def roster_search(spark, d):
    return reports.roster(table(spark, d, "players"), FOUNDER, "  Hold N1 ")


@query("""select id, player_id, session_type, started_at, created_at, duration_minutes from sessions where player_id = 8""")
def player_history_sessions(spark, d):
    return table(spark, d, "sessions").where("player_id = 8").orderBy("created_at", "id")


@query("""select pay.order_id, pay.line, pay.product_id, pay.amount_cents, pay.method, pay.paid_on
          from payments pay join players pl on pl.id = pay.player_id
          where pay.player_id = 8 and pay.location_id = pl.location_id""")
def player_history_payments(spark, d):
    p = table(spark, d, "players").select(F.col("id").alias("player_id"), F.col("location_id").alias("home"))
    return (
        table(spark, d, "payments")
        .where("player_id = 8")
        .join(p, "player_id")
        .where("location_id = home")
        .select("order_id", "line", "product_id", "amount_cents", "method", "paid_on")
        .orderBy("paid_on", "order_id", "line")
    )


@query("""select s.id, s.record_id, s.server_timestamp, e.player_id, e.product_id, p.first_name, p.last_name
          from sync_log s join entitlements e on e.id = s.record_id join players p on p.id = e.player_id
          where s.entity = 'entitlement' and s.action = 'update'""")
def player_history_draws(spark, d):
    return reports.draw_history(table(spark, d, "sync_log"), table(spark, d, "entitlements"), table(spark, d, "players"))


@query("""select e.id, e.player_id, e.product_id, e.remaining_units
          from entitlements e join players p on p.id = e.player_id where e.status = 'active' and e.location_id = 1""")
def entitlement_balance(spark, d):
    return reports.balances(table(spark, d, "entitlements"), table(spark, d, "players"), MANAGER)


@query("""select p.id as player_id,
                 case when bool_or(e.id is not null and e.remaining_units is null) then 'unlimited'
                      else cast(sum(e.remaining_units)::bigint as varchar) end as balance,
                 case when bool_or(e.status = 'active') then 'active' else coalesce(arg_min(e.status, e.id), 'none') end as status,
                 count(e.id) as held
          from players p left join entitlements e on e.player_id = p.id group by p.id""")
def balance_rollup(spark, d):
    return reports.balance_rollup(table(spark, d, "players"), table(spark, d, "entitlements"))


@query("""select p.id, max(coalesce(started_at, created_at)::date) as last_visit
          from players p left join sessions s on s.player_id = p.id group by p.id""")
def last_visit_roster(spark, d):
    return reports.last_visits(table(spark, d, "players"), table(spark, d, "sessions"))


@query("""select (select coalesce(sum(amount_cents), 0)::bigint from payments where paid_on = date '2000-04-04' and (method is null or method = 'cash')) as cash_cents,
                 (select count(*) from payments where paid_on = date '2000-04-04' and (method is null or method = 'cash')) as cash_payments,
                 (select count(*) from sessions where coalesce(started_at, created_at)::date = date '2000-04-04') as sessions,
                 (select coalesce(sum(amount_cents), 0) from payments where paid_on = date '2000-04-04' and (method is null or method = 'cash')) / 55000.0::double as pace""")
def today_totals(spark, d):
    return reports.today_totals(table(spark, d, "payments"), table(spark, d, "sessions"), date(2000, 4, 4))


@query("""select count(*) filter (action = 'insert') as applied, count(*) filter (action = 'skip') as skipped,
                 count(*) filter (device_id is null) as quarantined, max(server_timestamp) as latest,
                 max(server_timestamp) < timestamp '2024-01-26' as stale from sync_log""")
def sync_health(spark, d):
    return reports.sync_health(table(spark, d, "sync_log"), EVENTS_NOW)


@query("""select entity, action, count(*) as n from sync_log group by entity, action""")
def run_counters(spark, d):
    return table(spark, d, "sync_log").groupBy("entity", "action").agg(F.count(F.lit(1)).alias("n"))


@query("""select id, name, type, price_cents from products order by name, id""")
def product_list(spark, d):
    return table(spark, d, "products").select("id", "name", "type", "price_cents").orderBy("name", "id")


@query("""select type, min_by(name, id) as name, min(id) as id from products group by type""")
def catalog_first_by_type(spark, d):
    return table(spark, d, "products").groupBy("type").agg(F.min_by("name", "id").alias("name"), F.min("id").alias("id"))


@query("""select id, type, name, case when type = 'pay_per_use' and price_cents is distinct from 90000 then 90000 else price_cents end as price_cents
          from products""")
def price_correction(spark, d):
    wrong = (F.col("type") == "pay_per_use") & ~F.col("price_cents").eqNullSafe(F.lit(90000))
    return table(spark, d, "products").select("id", "type", "name", F.when(wrong, F.lit(90000)).otherwise(F.col("price_cents")).alias("price_cents"))
