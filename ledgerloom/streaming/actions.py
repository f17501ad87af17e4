"""Sync of offline actions as one stream: every entity, a result for each action, and
dependants that wait until what they refer to is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.entitlement import derive_window
from ledgerloom.operators import actions, ledger
from ledgerloom.operators.scope import Scope, sync_gate
from ledgerloom.sources.shared import Store, numbered, written
from ledgerloom.streaming.sync import run_stream

#: Entities, the tables of those with a natural key, and of these the
#: fields that a newer action replaces; the optional ones only if it has them.
ENTITIES = ("player", "consent", "session", "attendance", "payment", "entitlement", "student_metrics")
NATURAL = {"session": "sessions", "attendance": "attendance", "payment": "payments", "student_metrics": "student_metrics"}
MUTABLE = {"session": ("duration_minutes",), "attendance": ("present",), "payment": ("method",), "student_metrics": ("value",)}
OPTIONAL = {"session": ("reference",)}

ACTION = "client_id string, entity string, payload map<string,string>, created_at timestamp"
PLAYERS = "id long, first_name string, last_name string, birth_date string, grade string, location_id long, school_id long, name_key string, dedup_key string"
ENTITLEMENTS = (
    "id long, player_id long, product_id long, status string, remaining_units long, valid_from date, valid_to date, "
    "location_id long, school_id long, client_id string, version long"
)
ROWS = (
    "natural_key string, entity string, record_id long, player_id long, location_id long, school_id long, "
    "created_at timestamp, client_id string, payload map<string,string>"
)
CONSENTS = "id long, client_id string, player_id long, location_id long, payload map<string,string>, created_at timestamp"
RESULTS = "client_id string, entity string, status string, reason string, record_id long, batch long"
AUDIT = "entity string, record_id long, action string, client_id string, client_timestamp timestamp, user_id string"
RESOLVED = "local_id string, entity string, server_id long"

#: Results of a step: the action's number, what came of it, and what the audit says.
STEP = "_uid long, status string, reason string, record_id long, audit string"


def field(name: str) -> Column:
    return F.try_element_at("payload", F.lit(name))


def is_local(reference: Column) -> Column:
    """Ids of the server are whole numbers; any other reference is a client's own."""
    return reference.isNotNull() & ~F.rlike(reference, F.lit(r"^-?\d+$"))


def number(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit(r"^-?\d{1,19}$")), value.try_cast("long"))


def _join_key(reference: Column) -> Column:
    """A reference as a text to join by.  Rows without one get a key of their own that meets
    nothing: null keys would all be dealt into one task."""
    return F.coalesce(reference.cast("string"), F.concat(F.lit("\0"), F.col("_uid").cast("string")))


def _left_join(rows: DataFrame, reference: Column, other: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``other`` (but its key) where the reference is its key."""
    right = other.withColumnRenamed(key, "_right")
    joined = rows.withColumn("_left", _join_key(reference)).join(right, F.col("_left") == F.col("_right").cast("string"), "left")
    return joined.drop("_left", "_right")


def _told(rows: DataFrame, status: Column | str, reason: Column | str | None = None, record: Column | None = None, audit: Column | None = None) -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    values = (as_column(status), as_column(reason).cast("string"), as_column(record).cast("long"), as_column(audit).cast("string"))
    return rows.select("_uid", *[v.alias(n) for v, n in zip(values, ("status", "reason", "record_id", "audit"), strict=True)])


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _only(body: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(body, lambda k, _: k.isin(*names))


def _without(body: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(body, lambda k, _: ~k.isin(*names))


def _optional(entity: Column, body: Column) -> Column:
    """The optional mutable fields that an action gives, even as null."""
    out = _only(body, ())
    for name, fields in OPTIONAL.items():
        out = F.when(entity == name, _only(body, fields)).otherwise(out)
    return out


def _replaced(entity: Column, stored: Column, new: Column, given: Column) -> Column:
    """A stored payload after a newer action: its mutable fields are the action's (absent
    ones go), optional ones the last that were given, all others stay."""
    out = stored
    for name, always in MUTABLE.items():
        kept = F.map_filter(_without(stored, always), lambda k, _: ~F.map_contains_key(given, k))
        out = F.when(entity == name, F.map_concat(kept, _only(new, always), given)).otherwise(out)
    return F.map_filter(out, lambda _, v: v.isNotNull())


class ActionTables:
    """The tables that actions change, below one commit log.

    ``apply`` takes a micro-batch of actions (client_id, entity, payload, created_at).  They
    are applied by entity in levels: players, then sessions, then all others, each in
    order of time and client id.  An action that refers to a player or session by its
    client's id is held in the table ``waiting`` until that one is applied, in this batch
    or a later one, and is rejected when that one is.  Whatever is wrong with an action
    rejects it alone.  Rows, results, audit and waiting actions of a batch are one
    commit; a replayed batch changes nothing.

    Results are one row an action and delivery, in the order of the batches: ``applied``,
    ``skipped`` or ``rejected`` with the first reason that holds.
    """

    def __init__(self, spark: SparkSession, folder: str, scope: Scope, products: DataFrame, known_cents: Column, user: str | None = None):
        self.store = Store(spark, folder)
        self.spark, self.scope, self.products, self.known_cents, self.user = spark, scope, products, known_cents, user

    # -- tables ------------------------------------------------------------------

    def seed(self, players: DataFrame, entitlements: DataFrame | None = None) -> None:
        """Rows that the server has already; only the first call counts."""
        if self.store.done("seed"):
            return
        own = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
        people = players.select(*[own(players, *c.split()) for c in PLAYERS.split(", ")[:7]])
        rows = {"players": self._keyed(people)}
        if entitlements is not None:
            given = [own(entitlements, *c.split()) for c in ENTITLEMENTS.split(", ")[:-1]]
            rows["entitlements"] = entitlements.select(*given, F.lit(-1).cast("long").alias("version"))
        self.store.commit(rows, "seed")

    @staticmethod
    def _keyed(people: DataFrame) -> DataFrame:
        name = text.name_key(F.col("first_name"), F.col("last_name"))
        key = text.dedup_key(F.col("first_name"), F.col("last_name"), F.col("birth_date"))
        return people.withColumn("name_key", name).withColumn("dedup_key", key)

    def players(self) -> DataFrame:
        return self.store.table("players", PLAYERS)

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """Sessions, attendances, payments and metrics: the last version of each key (of ``keys``)."""
        newest = F.max_by(F.struct("entity", "record_id", "player_id", "location_id", "school_id", "created_at", "client_id", "payload"), ledger.version())
        stored = self.store.table("rows", ROWS)
        stored = stored if keys is None else stored.join(keys, "natural_key", "left_semi")
        return stored.groupBy("natural_key").agg(newest.alias("_r")).select("natural_key", "_r.*")

    def entitlements(self, ids: DataFrame | None = None) -> DataFrame:
        names = [c.split()[0] for c in ENTITLEMENTS.split(", ")]
        newest = F.max_by(F.struct(*names[1:]), "version").alias("_e")
        stored = self.store.table("entitlements", ENTITLEMENTS)
        stored = stored if ids is None else stored.join(ids, "id", "left_semi")
        return stored.groupBy("id").agg(newest).select("id", "_e.*")

    def consents(self) -> DataFrame:
        return self.store.table("consents", CONSENTS)

    def results(self) -> DataFrame:
        return self.store.table("results", RESULTS)

    def waiting(self) -> DataFrame:
        return self.store.table("waiting", ACTION)

    def audit(self) -> DataFrame:
        return self.store.table("audit", AUDIT)

    # -- a batch -----------------------------------------------------------------

    def apply(self, batch: DataFrame, batch_number: int) -> None:
        if self.store.done(batch_number):
            return
        names = [c.split()[0] for c in ACTION.split(", ")]
        arrived = self.waiting().unionByName(batch.select(*names))
        pending = numbered(arrived.withColumn("payload", F.coalesce("payload", F.create_map().cast("map<string,string>"))), "_uid", "actions")
        clean = F.map_filter("payload", lambda k, _: ~text.is_prohibited(k))
        gate = sync_gate(self.scope, F.col("entity"), ENTITIES, field("session_type"))
        gate = F.when(F.col("entity").isNull() | ~F.col("entity").isin(*ENTITIES), F.coalesce(gate, F.lit("unknown_entity"))).otherwise(gate)
        judged = pending.withColumn("payload", clean).withColumn("_gate", gate)
        steps = [_told(judged.where("_gate is not null"), "rejected", F.col("_gate"))]
        open_ = judged.where("_gate is null").drop("_gate")
        rows: dict[str, DataFrame] = {}

        step, rows["players"] = self._players(open_.where("entity = 'player'"))
        steps.append(step)
        known = written(self._known(pending, steps), "actions-known")
        sessions = written(self._resolved(open_.where("entity = 'session'"), known), "actions-sessions")
        people = self.players().unionByName(rows["players"])
        step, session_rows = self._natural(sessions, people, None)
        steps += [self._refused(sessions), step]
        known = written(self._known(pending, steps), "actions-known")
        rest = written(self._resolved(open_.where("entity not in ('player', 'session')"), known), "actions-rest")
        held = [x.where("_state = 'waiting'") for x in (sessions, rest)]
        stored = self.store.table("rows", ROWS).where("entity = 'session'")
        all_sessions = _together([x.select("record_id", "player_id") for x in (stored, session_rows)])
        step, other_rows = self._natural(rest, people, all_sessions)
        rows["rows"] = session_rows.unionByName(other_rows)
        steps += [self._refused(rest), step]
        step, rows["consents"] = self._consents(rest, people)
        steps.append(step)
        step, rows["entitlements"], rows["receipts"] = self._entitlements(rest, people, batch_number)
        steps.append(step)

        done = written(_together(steps).join(pending.select("_uid", "client_id", "entity", "created_at"), "_uid"), "actions-done")
        rows["results"] = done.select("client_id", "entity", "status", "reason", "record_id", F.lit(batch_number).cast("long").alias("batch"))
        rows["audit"] = done.where("audit is not null").select(
            "entity", "record_id", F.col("audit").alias("action"), "client_id", F.col("created_at").alias("client_timestamp"),
            F.lit(self.user).cast("string").alias("user_id"),
        )
        produced = done.where("entity in ('player', 'session') and status <> 'skipped' or record_id is not null")
        rows["resolved"] = produced.where("entity in ('player', 'session')").select(F.col("client_id").alias("local_id"), "entity", "record_id")
        rows["resolved"] = rows["resolved"].withColumnRenamed("record_id", "server_id")
        rows["waiting"] = _together(held).select(*names)
        self.store.commit(rows, batch_number, whole=("waiting",))

    def _known(self, pending: DataFrame, steps: list[DataFrame]) -> DataFrame:
        """local_id, entity, server_id: producers of all batches; null if all were rejected."""
        now = _together(steps).join(pending.where("entity in ('player', 'session')").select("_uid", "client_id", "entity"), "_uid")
        now = now.select(F.col("client_id").alias("local_id"), "entity", F.col("record_id").alias("server_id"))
        every = self.store.table("resolved", RESOLVED).unionByName(now)
        return every.groupBy("local_id", "entity").agg(F.max("server_id").alias("server_id"))

    @staticmethod
    def _resolved(rows: DataFrame, known: DataFrame) -> DataFrame:
        """Actions with _state (ready, waiting or refused) and the server's ids in their payload;
        the payload of one that waits is as it was sent."""
        out = rows
        for name, entity in (("player_id", "player"), ("session_id", "session")):
            ids = known.where(F.col("entity") == entity).select(F.col("local_id").alias(f"_{entity}"), F.col("server_id").alias(f"_{entity}_id"), F.lit(True).alias(f"_{entity}_told"))
            out = out.withColumn(f"_{entity}_ref", F.when(is_local(field(name)), field(name)))
            out = _left_join(out, F.col(f"_{entity}_ref"), ids, f"_{entity}")
        lost = lambda e: F.col(f"_{e}_ref").isNotNull() & F.col(f"_{e}_told").isNotNull() & F.col(f"_{e}_id").isNull()
        unknown = lambda e: F.col(f"_{e}_ref").isNotNull() & F.col(f"_{e}_told").isNull()
        state = F.when(lost("player") | lost("session"), "refused").when(unknown("player") | unknown("session"), "waiting").otherwise("ready")
        payload = F.col("payload")
        for name, entity in (("player_id", "player"), ("session_id", "session")):
            with_id = F.map_concat(_without(payload, (name,)), F.create_map(F.lit(name), F.col(f"_{entity}_id").cast("string")))
            payload = F.when(F.col(f"_{entity}_ref").isNotNull() & F.col(f"_{entity}_id").isNotNull(), with_id).otherwise(payload)
        payload = F.when(F.col("_state") == "waiting", F.col("payload")).otherwise(payload)
        return out.withColumn("_state", state).select("_uid", "client_id", "entity", payload.alias("payload"), "created_at", "_state")

    @staticmethod
    def _refused(resolved: DataFrame) -> DataFrame:
        return _told(resolved.where("_state = 'refused'"), "rejected", "producer_rejected")

    def _players(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Registrations: by dedup key inserted or found; a name with other keys is ambiguous."""
        given_location, given_school = number(field("location_id")), number(field("school_id"))
        outside = field("location_id").isNotNull() & ~self.scope.may_write(given_location, given_school)
        own_location = given_location if self.scope.unrestricted else F.lit(self.scope.location_id).cast("long")
        own_school = F.lit(self.scope.school_id).cast("long") if self.scope.role == "facilitator" else given_school
        people = rows.select(
            "_uid", "client_id", "created_at", *[field(n).alias(n) for n in ("first_name", "last_name", "birth_date", "grade")],
            own_location.alias("location_id"), own_school.alias("school_id"), F.coalesce(outside, F.lit(False)).alias("_outside"),
        )
        reason = F.when(F.col("_outside"), "out_of_scope").when(F.col("location_id").isNull(), "location_required")
        keyed = self._keyed(people).withColumn("_reason", F.coalesce(reason, F.when(F.col("name_key") == "|", "unresolved_player")))
        good = keyed.where("_reason is null")
        there = self.players().groupBy("name_key").agg(F.count_distinct("dedup_key").alias("_keys"), F.min("dedup_key").alias("_key"), F.min("id").alias("_there"))
        firsts = good.groupBy("name_key").agg(F.min(F.struct("created_at", "client_id", "_uid", "dedup_key")).alias("_first"))
        known = firsts.join(there, "name_key", "left").select(
            "name_key", F.coalesce("_key", "_first.dedup_key").alias("_key"), F.coalesce("_keys", F.lit(0)).alias("_keys"),
            F.coalesce("_there", F.xxhash64("_first.dedup_key")).alias("_id"), F.when(F.col("_keys").isNull(), F.col("_first._uid")).alias("_new"),
        )
        met = written(good.join(known, "name_key"), "actions-players")
        fits = (F.col("_keys") <= 1) & (F.col("dedup_key") == F.col("_key"))
        new = F.coalesce(F.col("_uid") == F.col("_new"), F.lit(False))
        step = _told(
            met, F.when(fits & new, "applied").when(fits, "skipped").otherwise("rejected"), F.when(~fits, "unresolved_player"),
            F.when(fits, F.col("_id")), F.when(fits & new, "insert").when(fits, "skip"),
        )
        bad = keyed.where("_reason is not null")
        names = [c.split()[0] for c in PLAYERS.split(", ")[1:]]
        return step.unionByName(_told(bad, "rejected", F.col("_reason"))), met.where(fits & new).select(F.col("_id").alias("id"), *names)

    def _natural(self, resolved: DataFrame, people: DataFrame, sessions: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Rows by natural key: inserted, or replaced by a newer action, else skipped."""
        entity = F.col("entity")
        ready = resolved.where((F.col("_state") == "ready") & entity.isin(*NATURAL))
        ready = ready.withColumn("payload", actions.normalized_payload(entity, F.col("payload"), self.known_cents))
        homes = people.select(F.col("id").alias("_home"), "location_id", "school_id", F.lit(True).alias("_there"))
        met = ready.withColumn("player_id", number(field("player_id"))).withColumn("_session", number(field("session_id")))
        met = _left_join(met, F.col("player_id"), homes, "_home")
        if sessions is None:
            met = met.withColumn("session_player", F.lit(None).cast("string")).withColumn("_found", F.lit(None).cast("boolean"))
        else:
            held = sessions.select(F.col("record_id").alias("_held"), F.col("player_id").cast("string").alias("session_player"), F.lit(True).alias("_found")).distinct()
            met = _left_join(met, F.col("_session"), held, "_held")
        lost = F.when(field("player_id").isNotNull() & F.col("_there").isNull(), "player_not_found").when(
            (entity == "attendance") & field("session_id").isNotNull() & F.col("_found").isNull(), "session_not_found"
        )
        own_school = entity.isin("session", "attendance") & field("school_id").isNotNull()
        wrong_school = own_school & ~self.scope.may_write(F.col("location_id"), field("school_id"))
        told = actions.action_reasons(met, self.scope).withColumn("reason", F.coalesce(lost, "reason", F.when(wrong_school, "out_of_scope")))
        bad = _told(told.where("reason is not null"), "rejected", F.col("reason"))
        key = F.lit(None).cast("string")
        for name, table in NATURAL.items():
            key = F.when(entity == name, text.sync_key(name, table, field)).otherwise(key)
        good = written(told.where("reason is null").withColumn("natural_key", key), "actions-rows")
        # equal versions of a key are one edit sent again: the first of them counts
        edits = good.groupBy("natural_key", "created_at", "client_id").agg(F.min("_uid").alias("_uid")).select("_uid")
        held = self.rows(good.select("natural_key"))
        stored = held.select("natural_key", ledger.version().alias("_held"), F.struct(*[c for c in held.columns if c != "natural_key"]).alias("_old"))
        newer = F.col("_held").isNull() | F.col("_held.created_at").isNull() | (ledger.version() > F.col("_held"))
        # compared are narrow columns; of the payloads only those that win are moved
        narrow = good.select("_uid", "natural_key", "created_at", "client_id").join(edits.withColumn("_once", F.lit(True)), "_uid", "left")
        compared = narrow.join(stored.select("natural_key", "_held"), "natural_key", "left")
        compared = written(compared.select("_uid", "natural_key", F.coalesce(F.col("_once") & newer, F.lit(False)).alias("_wins")), "actions-compared")
        wins = good.join(compared.where("_wins").select("_uid"), "_uid")
        given = _optional(entity, F.col("payload"))
        new = wins.groupBy("natural_key").agg(
            F.min(F.struct("created_at", "client_id", "_uid")).alias("_first"), F.max(ledger.version()).alias("_v"), F.first("entity").alias("entity"),
            F.min_by(F.struct("player_id", "location_id", "school_id", "payload"), ledger.version()).alias("_start"),
            F.max_by("payload", ledger.version()).alias("_last"), F.max_by(F.when(F.size(given) > 0, given), F.when(F.size(given) > 0, ledger.version())).alias("_given"),
        )
        new = written(new.join(stored.select("natural_key", "_old"), "natural_key", "left"), "actions-winners")
        base = F.coalesce("_old.payload", "_start.payload")
        made = new.select(
            "natural_key", "entity", F.xxhash64("natural_key").alias("record_id"),
            *[F.coalesce(F.col(f"_old.{c}"), F.col(f"_start.{c}")).alias(c) for c in ("player_id", "location_id", "school_id")],
            F.col("_v.created_at").alias("created_at"), F.col("_v.client_id").alias("client_id"),
            _replaced(F.col("entity"), base, F.col("_last"), F.coalesce(F.col("_given"), _only(base, ()))).alias("payload"),
        )
        firsts = new.where("_old is null").select(F.col("_first._uid").alias("_uid"), F.lit(True).alias("_inserts"))
        outcome = compared.join(firsts, "_uid", "left")
        audit = F.when(~F.col("_wins"), "skip").when(F.col("_inserts"), "insert").otherwise("update")
        step = _told(outcome, F.when(F.col("_wins"), "applied").otherwise("skipped"), None, F.xxhash64("natural_key"), audit)
        return step.unionByName(bad), made

    def _judged(self, rows: DataFrame, people: DataFrame) -> DataFrame:
        homes = people.select(F.col("id").alias("_home"), "location_id", "school_id", F.lit(True).alias("_there"))
        met = _left_join(rows.withColumn("player_id", number(field("player_id"))), F.col("player_id"), homes, "_home")
        met = met.withColumn("session_player", F.lit(None).cast("string"))
        lost = F.when(field("player_id").isNotNull() & F.col("_there").isNull(), "player_not_found")
        return actions.action_reasons(met, self.scope).withColumn("reason", F.coalesce(lost, "reason"))

    def _once(self, good: DataFrame, stored: DataFrame) -> DataFrame:
        """Rows with _new: the first of each client id that the table lacks."""
        firsts = good.groupBy("client_id").agg(F.min(F.struct("created_at", "_uid"))["_uid"].alias("_uid"))
        held = stored.where("client_id is not null").select("client_id").distinct()
        new = firsts.join(held, "client_id", "left_anti").select("_uid", F.lit(True).alias("_new"))
        return good.join(new, "_uid", "left").withColumn("_new", F.coalesce("_new", F.lit(False)))

    def _consents(self, resolved: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Consents are appended once for each client id."""
        judged = self._judged(resolved.where("_state = 'ready' and entity = 'consent'"), people)
        good = written(judged.where("reason is null"), "actions-consents")
        met = written(self._once(good, self.consents()), "actions-consents")
        id_ = F.xxhash64(F.lit("consent"), "client_id")
        step = _told(met, F.when(F.col("_new"), "applied").otherwise("skipped"), None, id_, F.when(F.col("_new"), "insert").otherwise("skip"))
        bad = _told(judged.where("reason is not null"), "rejected", F.col("reason"))
        made = met.where("_new").select(id_.alias("id"), "client_id", "player_id", "location_id", "payload", "created_at")
        return step.unionByName(bad), made

    def _entitlements(self, resolved: DataFrame, people: DataFrame, batch_number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Entitlements created once for each client id, then draws against all of them."""
        ready = resolved.where("_state = 'ready' and entity = 'entitlement'")
        is_draw = field("entitlement_id").isNotNull() & field("amount").isNotNull()
        rules = self.products.select(F.col("id").cast("long").alias("product_id"), "rules", F.lit(True).alias("_sold"))
        asked = self._judged(ready.where(~is_draw).withColumn("payload", _without(F.col("payload"), ("entitlement_id",))), people)
        asked = asked.withColumn("product_id", number(field("product_id"))).join(rules, "product_id", "left")
        asked = asked.withColumn("reason", F.coalesce("reason", F.when(F.col("_sold").isNull(), "product_not_found")))
        good = written(asked.where("reason is null"), "actions-entitlements")
        met = written(self._once(good, self.store.table("entitlements", ENTITLEMENTS)), "actions-entitlements")
        id_ = F.xxhash64(F.lit("entitlement"), "client_id")
        window = derive_window(F.col("rules"), F.to_date("created_at"))
        version = F.lit(batch_number).cast("long").alias("version")
        made = written(
            met.where("_new").withColumn("_w", window).select(
                id_.alias("id"), "player_id", "product_id", F.lit("active").alias("status"), F.col("_w.remaining_units").cast("long").alias("remaining_units"),
                F.col("_w.valid_from").alias("valid_from"), F.col("_w.valid_to").alias("valid_to"), "location_id", "school_id", "client_id", version,
            ),
            "actions-made",
        )
        steps = [
            _told(asked.where("reason is not null"), "rejected", F.col("reason")),
            _told(met, F.when(F.col("_new"), "applied").otherwise("skipped"), None, id_, F.when(F.col("_new"), "insert").otherwise("skip")),
        ]

        wanted = ready.where(is_draw).select(number(field("entitlement_id")).alias("id"))
        every = written(self.entitlements(wanted).unionByName(made), "actions-units")
        homes = every.select(F.col("id").alias("entitlement_id"), "location_id", "school_id", F.lit(True).alias("_there"))
        draws = ready.where(is_draw).withColumn("entitlement_id", number(field("entitlement_id"))).join(homes, "entitlement_id", "left")
        lost = F.when(F.col("_there").isNull(), "not_found").when(~self.scope.may_write(F.col("location_id"), F.col("school_id")), "out_of_scope")
        draws = written(draws.withColumn("reason", lost), "actions-draws")
        steps.append(_told(draws.where("reason is not null"), "rejected", F.col("reason"), F.when(F.col("_there"), F.col("entitlement_id"))))
        at = F.struct(F.col("created_at").alias("at"), "_uid").alias("created_at")
        units = every.join(rules.drop("_sold"), "product_id", "left").withColumnRenamed("id", "entitlement_id")
        receipts = self.store.table("receipts", "client_id string")
        told = ledger.draws_in_order(
            units.select("entitlement_id", "remaining_units", "status", "valid_from", "rules"),
            draws.where("reason is null").select("entitlement_id", "client_id", at, number(field("amount")).alias("amount")),
            today=F.to_date("created_at.at"), receipts=receipts, rejected_too=False,
        )
        told = written(told.withColumn("_uid", F.col("created_at._uid")), "actions-told")
        steps.append(_told(told, F.col("status"), F.col("reason"), F.col("entitlement_id"), F.col("audit")))
        last = told.groupBy("entitlement_id").agg(F.max_by(F.struct("remaining", "since"), "created_at").alias("_l"))
        changed = every.drop("version").join(last, every["id"] == last["entitlement_id"]).drop("entitlement_id")
        changed = changed.withColumn("remaining_units", F.col("_l.remaining")).withColumn("valid_from", F.col("_l.since")).drop("_l")
        left = made.join(changed.select("id"), "id", "left_anti").unionByName(changed.withColumn("version", version))
        return _together(steps), left, told.where("status = 'applied' and client_id is not null").select("client_id")


def sync_actions(tables: ActionTables, sent: DataFrame, folder: str, files_per_batch: int = 0) -> DataFrame:
    """Stream actions into the tables and return all results so far.

    What is sent is added to the files below ``folder``, which the stream reads from where
    it stopped: a later call, or another process, goes on with the same folder.
    """
    names = [c.split()[0] for c in ACTION.split(", ")]
    sent.select(*names).write.mode("append").parquet(f"{folder}/actions")
    reader = sent.sparkSession.readStream.schema(ACTION)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    run_stream(reader.parquet(f"{folder}/actions"), tables.apply, f"{folder}/stream")
    return tables.results()
