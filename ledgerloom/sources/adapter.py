"""Business tables as deterministic views over the star schema of the test data.

``table(spark, sf_dir, name)`` gives the view; ``SQL`` has the same views for the
oracles, written independently.  No operator knows of this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locations(spark, d):
    return raw(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def schools(spark, d):
    return raw(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("location_id")
    )


def players(spark, d):
    c, s = raw(spark, d, "customer"), schools(spark, d)
    return c.join(F.broadcast(s), c["c_nationkey"] == s["id"]).select(
        F.col("c_custkey").alias("id"),
        F.initcap("c_mktsegment").alias("first_name"),
        F.concat(F.lit("N"), (F.col("c_custkey") % 400).cast("string")).alias("last_name"),
        F.date_add(F.lit("2008-01-01").cast("date"), (F.col("c_custkey") % 7 * 300).cast("int")).alias("birth_date"),
        F.col("c_nationkey").alias("school_id"),
        "location_id",
        (F.col("c_acctbal") >= 0).alias("active"),
    )


def products(spark, d):
    kind = (
        F.when(F.col("p_type").isin("SMALL", "MEDIUM"), "pay_per_use")
        .when(F.col("p_type").isin("STANDARD", "LARGE"), "subscription")
        .otherwise("once_off_pass")
    )
    return raw(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        kind.alias("type"),
        F.bround(F.col("p_retailprice") * 100, 0).cast("long").alias("price_cents"),
        F.col("p_size").alias("size"),
    )


def payments(spark, d):
    line, order, p = raw(spark, d, "lineitem"), raw(spark, d, "orders"), players(spark, d)
    return (
        line.join(order, line["l_orderkey"] == order["o_orderkey"])
        .join(p.select(F.col("id").alias("player_id"), "location_id"), F.col("o_custkey") == F.col("player_id"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            "player_id",
            "location_id",
            F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("product_id"),
            F.bround(F.col("l_extendedprice") * 100, 0).cast("long").alias("amount_cents"),
            F.when(F.col("l_linestatus") == "O", "cash").otherwise("eft").alias("method"),
            F.to_date("l_shipdate").alias("paid_on"),
        )
    )


def entitlements(spark, d):
    o, p = raw(spark, d, "orders"), players(spark, d)
    key = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    return o.join(p.select(F.col("id").alias("player_id"), "location_id", "school_id"), F.col("o_custkey") == F.col("player_id")).select(
        key.alias("id"),
        "player_id",
        "location_id",
        "school_id",
        (key % 200).alias("product_id"),
        F.when(F.col("o_orderstatus") == "O", "active")
        .when(F.col("o_orderstatus") == "F", "expired")
        .otherwise("cancelled")
        .alias("status"),
        F.when(key % 7 != 0, F.floor("o_totalprice") % 300).alias("remaining_units"),
        start.alias("valid_from"),
        F.when(key % 5 != 0, F.date_add(start, (key % 60 + 30).cast("int"))).alias("valid_to"),
    )


def sessions(spark, d):
    e = raw(spark, d, "events").where(F.col("event_type").isin("view", "click", "signup"))
    kind = F.element_at(F.array(*map(F.lit, ("lesson", "kit", "esports", "lounge"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("player_id"),
        kind.alias("session_type"),
        F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("started_at"),
        F.col("ts").alias("created_at"),
        F.floor("value").alias("duration_minutes"),
    )


def sync_log(spark, d):
    e, p = raw(spark, d, "events"), players(spark, d)
    entity = (
        F.when(F.col("event_type") == "click", "session")
        .when(F.col("event_type") == "purchase", "payment")
        .when(F.col("event_type") == "view", "entitlement")
        .when(F.col("event_type") == "signup", "player")
        .otherwise("consent")
    )
    action = F.element_at(F.array(*map(F.lit, ("insert", "update", "delete", "skip"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.join(p.select(F.col("id").alias("_p"), "location_id"), F.col("user_id") == F.col("_p")).select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 13 != 0, F.floor(F.col("event_id") / 50)).alias("device_id"),
        "user_id",
        "location_id",
        entity.alias("entity"),
        action.alias("action"),
        (F.col("event_id") * 7 % 1500).alias("record_id"),
        F.col("ts").alias("server_timestamp"),
    )


def edits(spark, d):
    """Edits of one logical record per (user, event type), as devices send them."""
    return raw(spark, d, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("natural_key"),
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("created_at"),
        F.concat(F.lit("c"), F.lpad((F.col("event_id") * 7919 % 100000).cast("string"), 6, "0"), F.lit("-"), F.col("event_id").cast("string")).alias("client_id"),
        F.col("event_id").alias("seq"),
        "value",
    )


TABLES = {f.__name__: f for f in (locations, schools, players, products, payments, entitlements, sessions, sync_log, edits)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return TABLES[name](spark, sf_dir)


SQL = {
    "locations": "select r_regionkey as id, r_name as name from region",
    "schools": "select n_nationkey as id, n_name as name, n_regionkey as location_id from nation",
    "players": """
        select c_custkey as id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as first_name,
               'N' || (c_custkey % 400) as last_name,
               cast(date '2008-01-01' + cast(c_custkey % 7 * 300 as integer) as date) as birth_date,
               c_nationkey as school_id, n_regionkey as location_id, c_acctbal >= 0 as active
        from customer join nation on n_nationkey = c_nationkey""",
    "products": """
        select p_partkey as id, p_name as name,
               case when p_type in ('SMALL', 'MEDIUM') then 'pay_per_use'
                    when p_type in ('STANDARD', 'LARGE') then 'subscription' else 'once_off_pass' end as type,
               cast(round(p_retailprice * 100) as bigint) as price_cents, p_size as size
        from part""",
    "payments": """
        select l_orderkey as order_id, l_linenumber as line, o_custkey as player_id, n_regionkey as location_id,
               case when l_linenumber <> 7 then l_partkey end as product_id,
               cast(round(l_extendedprice * 100) as bigint) as amount_cents,
               case when l_linestatus = 'O' then 'cash' else 'eft' end as method,
               cast(l_shipdate as date) as paid_on
        from lineitem join orders on o_orderkey = l_orderkey
             join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""",
    "entitlements": """
        select o_orderkey as id, o_custkey as player_id, n_regionkey as location_id, c_nationkey as school_id,
               o_orderkey % 200 as product_id,
               case o_orderstatus when 'O' then 'active' when 'F' then 'expired' else 'cancelled' end as status,
               case when o_orderkey % 7 <> 0 then cast(floor(o_totalprice) as bigint) % 300 end as remaining_units,
               cast(o_orderdate as date) as valid_from,
               case when o_orderkey % 5 <> 0
                    then cast(cast(o_orderdate as date) + cast(o_orderkey % 60 + 30 as integer) as date) end as valid_to
        from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""",
    "sessions": """
        select event_id as id, user_id as player_id,
               ['lesson', 'kit', 'esports', 'lounge'][event_id % 4 + 1] as session_type,
               case when event_id % 11 <> 0 then ts end as started_at, ts as created_at,
               cast(floor(value) as bigint) as duration_minutes
        from events where event_type in ('view', 'click', 'signup')""",
    "sync_log": """
        select event_id as id, case when event_id % 13 <> 0 then event_id // 50 end as device_id, user_id,
               n_regionkey as location_id,
               case event_type when 'click' then 'session' when 'purchase' then 'payment'
                    when 'view' then 'entitlement' when 'signup' then 'player' else 'consent' end as entity,
               ['insert', 'update', 'delete', 'skip'][event_id % 4 + 1] as action,
               event_id * 7 % 1500 as record_id, ts as server_timestamp
        from events join customer on c_custkey = user_id join nation on n_nationkey = c_nationkey""",
    "edits": """
        select user_id || '|' || event_type as natural_key, date_trunc('hour', ts) as created_at,
               'c' || lpad(cast(event_id * 7919 % 100000 as varchar), 6, '0') || '-' || event_id as client_id,
               event_id as seq, value
        from events""",
}


def with_views(sql: str) -> str:
    """``sql`` behind the views that it names."""
    import re

    used = [n for n in SQL if re.search(rf"\b{n}\b", sql)]
    head = ",\n".join(f"{n} as ({SQL[n]})" for n in used)
    if not head:
        return sql
    rest = sql.strip()
    for opening in ("with recursive ", "with "):
        if rest.lower().startswith(opening):
            return f"{opening}{head},\n{rest[len(opening):]}"
    return f"with {head}\n{rest}"
