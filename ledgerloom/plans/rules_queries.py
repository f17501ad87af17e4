"""Captures, rejections, users, roles and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import actions
from ledgerloom.operators.scope import Scope
from ledgerloom.plans.registry import query
from ledgerloom.sources import schema
from ledgerloom.sources.adapter import raw, table
from ledgerloom.streaming.sync import shared_folder


def _captures(spark, d):
    e = raw(spark, d, "events").where("event_type = 'click'")
    k = F.col("event_id")
    now = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(
        k.cast("string").alias("capture_id"), now.alias("now"), F.date_format(F.col("ts") + F.expr("interval 30 minutes"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ended_at"),
        F.col("user_id").cast("string").alias("player_id"), F.lit("PS5").alias("console"), F.lit(30).alias("minutes"),
        F.when(k % 2 == 0, F.floor("value")).alias("amount_cents"), (k % 400).alias("entitlement_id"),
    )


@query("""select strftime(ts, '%Y-%m-%d') as day, event_id || '-1' as client_id, 'session' as entity, 6 as fields from events where event_type = 'click'
          union all select strftime(ts, '%Y-%m-%d'), event_id || '-2', case when event_id % 2 = 0 then 'payment' else 'entitlement' end,
                           case when event_id % 2 = 0 then 4 else 2 end from events where event_type = 'click'""")
def capture_sessions(spark, d):
    out = actions.session_actions(_captures(spark, d))
    return out.select("day", "client_id", "entity", F.size("payload").alias("fields"))


@query("""select event_id || '-p' as client_id, 'payment' as entity, user_id::varchar as player from events where event_type = 'purchase'
          union all select event_id || '-e' || i, 'entitlement', m from (
            select event_id, unnest(case event_id % 3 when 0 then ['a', 'b', 'c', 'd'] when 1 then [user_id::varchar] else []::varchar[] end) as m,
                   generate_subscripts(case event_id % 3 when 0 then ['a', 'b', 'c', 'd'] when 1 then [user_id::varchar] else []::varchar[] end, 1) - 1 as i
            from events where event_type = 'purchase')""")
def capture_sales(spark, d):
    k = F.col("event_id") % 3
    c = raw(spark, d, "events").where("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("capture_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("now"),
        F.when(k == 0, "subscription").when(k == 1, "once_off_pass").otherwise("pay_per_use").alias("kind"),
        F.col("user_id").cast("string").alias("player_id"), F.lit("7").alias("product_id"), F.lit(1000).alias("price_cents"),
        F.array(*map(F.lit, "abacdea")).alias("members"),
    )
    out = actions.sale_actions(c)
    return out.select("client_id", "entity", F.try_element_at("payload", F.lit("player_id")).alias("player"))


@query("""select event_id || '-' || k || '0' as client_id, case k when 's' then 'session' else 'attendance' end as entity
          from events, (values ('s'), ('a')) v(k) where event_type = 'signup'""")
def capture_attendance(spark, d):
    c = raw(spark, d, "events").where("event_type = 'signup'").select(
        F.col("event_id").cast("string").alias("capture_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("now"),
        F.lit("lesson").alias("session_type"), F.lit("r").alias("reference"), F.lit("6").alias("school_id"),
        F.array(F.struct(F.lit("x").alias("player_id"), F.lit(False).alias("present")), F.struct(F.lit("y").alias("player_id"), F.lit(True).alias("present"))).alias("roster"),
    )
    return actions.in_sync_order(actions.attendance_actions(c)).select("client_id", "entity")


@query("""with a as (select event_id, event_id % 8 as k, n_regionkey as location_id, c_nationkey as school_id
                     from events join customer on c_custkey = user_id join nation on n_nationkey = c_nationkey)
    select event_id as id, case
        when k in (1, 3) then 'player_required'
        when location_id <> 1 then 'out_of_scope'
        when k = 2 then 'consent_type_required' when k = 4 then 'session_player_mismatch' when k = 5 then 'bad_amount'
        when k = 6 then 'invalid_metric_type' when k = 7 then 'value_required' end as reason from a""")
def action_reasons(spark, d):
    p = table(spark, d, "players").select(F.col("id").alias("user_id"), "location_id", "school_id")
    e = raw(spark, d, "events").join(p, "user_id")
    k = F.col("event_id") % 8
    who = F.when(~k.isin(1, 3), F.col("user_id"))
    body = actions.payload(
        player_id=who, session_id=F.when(k == 4, F.lit("s")), amount_cents=F.when(k == 0, F.lit(5)), metric_type=F.when(k == 6, "height").when(k == 7, "typing_wpm"),
        consent_type=F.when(k == 2, F.lit("")),
    )
    entity = F.when(k == 0, "payment").when(k == 1, "consent").when(k == 2, "consent").when(k == 3, "session").when(k == 4, "attendance").when(k == 5, "payment").otherwise("student_metrics")
    rows = e.select(F.col("event_id").alias("id"), entity.alias("entity"), body.alias("payload"), "location_id", "school_id", F.lit("nobody").alias("session_player"))
    return actions.action_reasons(rows, Scope("manager", 1)).select("id", "reason")


@query("""select identifier, case when n_exact = 1 then exact when n_exact = 0 and n_loose = 1 then loose end as user_id from (
            select s_name as identifier, (select count(distinct u.s_suppkey) from supplier u where u.s_name = s.s_name) as n_exact,
                   (select min(u.s_suppkey) from supplier u where u.s_name = s.s_name) as exact, 0 as n_loose, null::bigint as loose from supplier s
            union all select ' ' || upper(s_name) || ' ', 0, null, 1, s_suppkey from supplier
            union all select 'nobody', 0, null, 0, null)""")
def user_lookup(spark, d):
    s = raw(spark, d, "supplier")
    users = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string"), F.lit("@x")).alias("email"))
    asked = s.select(F.col("s_name").alias("identifier")).unionByName(s.select(F.concat(F.lit(" "), F.upper("s_name"), F.lit(" ")).alias("identifier")))
    asked = asked.unionByName(spark.createDataFrame([("nobody",)], "identifier string"))
    return actions.lookup_users(asked, users)


@query("""with recursive g as (select n_nationkey as member, n_nationkey // 2 as role from nation where n_nationkey > 0),
               r as (select member, role from g union select r.member, g.role from r join g on g.member = r.role)
          select member, role from r""")
def role_reachability(spark, d):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "roles"))
    n = raw(spark, d, "nation").where("n_nationkey > 0")
    return actions.reachable_roles(n.select(F.col("n_nationkey").alias("member"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("role")))


@query("""select s_suppkey as id, r_name as location, case when s_suppkey % 3 <> 0 then n_name end as school
          from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey""")
def users_with_places(spark, d):
    """Users with their location, and their school where they have one."""
    s = raw(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("_home"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("_school"))
    n, r = table(spark, d, "schools"), table(spark, d, "locations")
    home = n.select(F.col("id").alias("_home"), "location_id").join(r.select(F.col("id").alias("location_id"), F.col("name").alias("location")), "location_id")
    own = n.select(F.col("id").alias("_school"), F.col("name").alias("school"))
    return s.join(home, "_home").join(own, "_school", "left").select("id", "location", "school")


@query("""select distinct price_cents as cents from products where price_cents > 0 union select unnest([1000, 3000, 5000])""")
def known_cents(spark, d):
    tiers = spark.createDataFrame([(1000,), (3000,), (5000,)], "cents long")
    return table(spark, d, "products").where("price_cents > 0").select(F.col("price_cents").alias("cents")).unionByName(tiers).distinct()


@query("""select name, min(id) as first_seen from products group by name""")
def distinct_in_order(spark, d):
    """Distinct names in the order in which they first appear."""
    return table(spark, d, "products").groupBy("name").agg(F.min("id").alias("first_seen")).orderBy("first_seen")


@query("""select product_id, count(*) as n from payments where product_id is not null and product_id not in (select s_suppkey from supplier) group by 1""")
def orphan_payments(spark, d):
    out = schema.orphans(table(spark, d, "payments"), "product_id", raw(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))
    return out.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


@query("""select name, count(*) as n from products group by name having count(*) > 1""")
def duplicate_names(spark, d):
    return schema.duplicate_keys(table(spark, d, "products"), "name")


@query("""select id, case when id in (select s_suppkey from supplier) then 'present' else 'created' end as state from products""")
def seed_if_absent(spark, d):
    p = table(spark, d, "products")
    there = raw(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("_there"))
    return p.join(there, "id", "left").select("id", F.when(F.col("_there"), "present").otherwise("created").alias("state"))
