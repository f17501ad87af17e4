"""Extracted records: privacy filter, validation, identity, keys and loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import dates, money, text
from ledgerloom.sources.shared import numbered

#: Reasons to flag a record, date fields by table, kinds of sessions.
REASONS = ("LOW_CONFIDENCE", "IMPOSSIBLE_DATE", "UNKNOWN_NAME", "AMOUNT_NO_TIER")
DATE_FIELDS = {
    "players": ("birth_date",), "sessions": ("started_at", "ended_at"), "payments": ("paid_at",),
    "student_metrics": ("measured_at",), "lessons": (),
}
SESSION_TYPES = ("lesson", "kit", "esports", "lounge")


def privacy_filter(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads without prohibited keys, and the sorted names of those dropped."""
    kept = F.map_filter(payload, lambda k, _: ~text.is_prohibited(k))
    dropped = F.array_sort(F.array_except(F.map_keys(payload), F.map_keys(kept)))
    return records.select(*[c for c in records.columns if c != payload], kept.alias(payload), dropped.alias("dropped_keys"))


def field(payload: Column, name: str) -> Column:
    return F.try_element_at(payload, F.lit(name))


def candidate_name(table: Column, payload: Column) -> Column:
    """The name that a record speaks of: first and last of a player, else player_name."""
    own = F.concat_ws(" ", F.coalesce(field(payload, "first_name"), F.lit("")), F.coalesce(field(payload, "last_name"), F.lit("")))
    return F.when(table == "players", text.slug(own)).when(table != "lessons", text.slug(field(payload, "player_name")))


def validate(
    records: DataFrame,
    known_names: DataFrame | None,
    known_cents: Column,
    reference: Column,
    threshold: float = 0.7,
    flag_unknown_when_empty: bool = False,
) -> DataFrame:
    """Records with ``reasons`` (all that apply, in a fixed order) and ``status``.

    ``known_names`` has one column ``slug``; it may be large and meets the records
    by key.  Lessons have no name to check.
    """
    table, payload = F.col("target_table"), F.col("payload")
    impossible = F.lit(False)
    for name, fields in DATE_FIELDS.items():
        for f in fields:
            impossible = impossible | (
                (table == name) & dates.impossible_date(field(payload, f), reference, birth=f == "birth_date")
            )
    named = records.withColumn("_name", candidate_name(table, payload))
    any_known = known_names is not None and not known_names.isEmpty()
    if any_known:
        names = known_names.select(F.col("slug").alias("_name")).distinct().withColumn("_known", F.lit(True))
        named = named.join(names, "_name", "left")
    else:
        named = named.withColumn("_known", F.lit(False))
    check = any_known or flag_unknown_when_empty
    unknown = F.lit(check) & F.col("_name").isNotNull() & (F.length("_name") > 0) & F.col("_known").isNull() if any_known else (
        F.lit(check) & F.col("_name").isNotNull() & (F.length("_name") > 0)
    )
    no_tier = (table == "payments") & ~F.coalesce(money.matches_known(field(payload, "amount"), known_cents), F.lit(False))
    tests = (F.col("confidence_score") < threshold, impossible, unknown, no_tier)
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)]))
    out = named.withColumn("reasons", reasons).drop("_name", "_known")
    return out.withColumn("status", F.when(F.size("reasons") == 0, "clean").otherwise("flagged"))


def review_rows(validated: DataFrame) -> DataFrame:
    """Flagged records as the review file's rows; columns that the records lack are empty."""
    own = lambda c: F.col(c) if c in validated.columns else F.lit(None).cast("string").alias(c)
    return validated.where(F.col("status") == "flagged").select(
        "record_id", "target_table", "confidence_score", "source_file", own("provider"), own("extracted_at"),
        F.array_join("reasons", ";").alias("reasons"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))).alias("payload"),
    )


def approve(validated: DataFrame, approved: DataFrame) -> DataFrame:
    """Flagged records whose id was approved become clean and lose their reasons."""
    ids = approved.select("record_id").distinct().withColumn("_ok", F.lit(True))
    joined = validated.join(ids, "record_id", "left")
    ok = F.coalesce("_ok", F.lit(False))
    return joined.select(
        *[c for c in validated.columns if c not in ("reasons", "status")],
        F.when(ok, F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("reasons"),
        F.when(ok, "clean").otherwise(F.col("status")).alias("status"),
    )


def name_index(players: DataFrame) -> DataFrame:
    """(slug, player_id, holders): full names and bare first names; null id if several."""
    full = players.select(text.slug(F.concat_ws(" ", "first_name", "last_name")).alias("slug"), "id")
    first = players.select(text.slug(F.col("first_name")).alias("slug"), "id")
    found = full.unionByName(first).where(F.length("slug") > 0)
    counted = found.groupBy("slug").agg(F.count_distinct("id").alias("holders"), F.min("id").alias("_one"))
    return counted.select("slug", F.when(F.col("holders") == 1, F.col("_one")).alias("player_id"), "holders")


def resolve_names(records: DataFrame, name: Column, index: DataFrame) -> DataFrame:
    """Records with player_id and outcome: resolved, UNRESOLVED_PLAYER or AMBIGUOUS_PLAYER."""
    joined = records.withColumn("_slug", text.slug(name)).join(index.withColumnRenamed("slug", "_slug"), "_slug", "left")
    outcome = (
        F.when(F.col("holders").isNull(), "UNRESOLVED_PLAYER").when(F.col("holders") > 1, "AMBIGUOUS_PLAYER").otherwise("resolved")
    )
    return joined.withColumn("outcome", outcome).drop("_slug", "holders")


#: Reasons at load time and of consents, each in the order of its tests.
LOAD_REASONS = (
    "UNRESOLVED_PLAYER", "AMBIGUOUS_PLAYER", "BAD_SESSION_TYPE", "BAD_AMOUNT", "UNRESOLVED_SCHOOL", "UNRESOLVED_PRODUCT",
)
CONSENT_REASONS = ("MISSING_PLAYER", "UNRESOLVED_PLAYER", "AMBIGUOUS_PLAYER", "MISSING_CONSENT_TYPE")
#: Tables whose rows belong to a player.
PLAYER_TABLES = ("sessions", "payments", "student_metrics")


def reference_index(rows: DataFrame) -> DataFrame:
    """(slug, id) of a reference table's names; a name that several ids hold has none."""
    named = rows.select(text.slug(F.col("name")).alias("slug"), "id").where(F.length("slug") > 0)
    found = named.groupBy("slug").agg(F.count_distinct("id").alias("_ids"), F.min("id").alias("_one"))
    return found.select("slug", F.when(F.col("_ids") == 1, F.col("_one")).alias("id"))


def _with_reference(rows: DataFrame, table: str, name: str, index: DataFrame, out: str) -> DataFrame:
    """Rows with the id that their optional name has, and whether a name was given in vain."""
    given = F.when(F.col("target_table") == table, text.blank_to_null(field(F.col("payload"), name)))
    found = index.select(F.col("slug").alias(f"_{out}_slug"), F.col("id").alias(out))
    joined = rows.withColumn(f"_{out}_slug", text.slug(given)).join(found, f"_{out}_slug", "left")
    lost = (F.length(f"_{out}_slug") > 0) & F.col(out).isNull()
    return joined.withColumn(f"_no_{out}", F.coalesce(lost, F.lit(False))).drop(f"_{out}_slug")


def resolve_references(records: DataFrame, players: DataFrame, schools: DataFrame, products: DataFrame, known_cents: Column) -> DataFrame:
    """Records with player_id, school_id, product_id, amount_cents and load_reason.

    The indexes are those of ``name_index`` and ``reference_index``.  A school (of
    sessions) and a product (of payments) may be absent; a name that none or several
    have is a reason, and the first of ``LOAD_REASONS`` that holds is given.
    """
    table, payload = F.col("target_table"), F.col("payload")
    rows = resolve_names(records, field(payload, "player_name"), players)
    rows = _with_reference(rows, "sessions", "school_name", schools, "school_id")
    rows = _with_reference(rows, "payments", "product_name", products, "product_id")
    rows = rows.withColumn("amount_cents", F.when(table == "payments", money.to_cents(field(payload, "amount"), known_cents)))
    kind = F.lower(F.trim(field(payload, "session_type")))
    owned = table.isin(*PLAYER_TABLES)
    tests = (
        owned & (F.col("outcome") == "UNRESOLVED_PLAYER"), owned & (F.col("outcome") == "AMBIGUOUS_PLAYER"),
        (table == "sessions") & ~F.coalesce(kind.isin(*SESSION_TYPES), F.lit(False)),
        (table == "payments") & F.col("amount_cents").isNull(), F.col("_no_school_id"), F.col("_no_product_id"),
    )
    reason = first_failure(table, dict(zip(LOAD_REASONS, tests, strict=True)))
    return rows.withColumn("load_reason", reason).drop("outcome", "_no_school_id", "_no_product_id")


def granted(value: Column) -> Column:
    """What a consent's field says; anything else, and nothing, counts as given."""
    word = F.lower(F.trim(value.cast("string")))
    return ~F.coalesce(word.isin(*text.FALSE_WORDS), F.lit(False))


def consent_outcomes(records: DataFrame, players: DataFrame) -> DataFrame:
    """Consent records with player_id, consent_type, granted, granted_at, method and reason.

    ``reason`` is the first of ``CONSENT_REASONS`` that holds; rows without one may
    be appended to the ledger.
    """
    payload = F.col("payload")
    name, kind = field(payload, "player_name"), text.blank_to_null(field(payload, "consent_type"))
    rows = resolve_names(records.where("target_table = 'consents'"), name, players)
    tests = (
        ~text.present(name), F.col("outcome") == "UNRESOLVED_PLAYER", F.col("outcome") == "AMBIGUOUS_PLAYER", kind.isNull(),
    )
    reason = first_failure(F.col("target_table"), dict(zip(CONSENT_REASONS, tests, strict=True)))
    return rows.select(
        *records.columns, "player_id", kind.alias("consent_type"), granted(field(payload, "granted")).alias("granted"),
        field(payload, "granted_at").alias("granted_at"), field(payload, "method").alias("method"), reason.alias("reason"),
    )


def distinct_names(*lists: DataFrame) -> DataFrame:
    """Names of several tables (name), each once."""
    out = lists[0].select("name")
    for more in lists[1:]:
        out = out.unionByName(more.select("name"))
    return out.where(text.present(F.col("name"))).select(F.trim("name").alias("name")).distinct()


def merge_attributes(candidates: DataFrame, key: str, attributes: list[str], confidence: str, order: str) -> DataFrame:
    """Per key and attribute the present value of highest confidence, the earliest on ties."""
    picks = [
        F.max_by(F.when(text.present(F.col(a)), F.col(a)), F.when(text.present(F.col(a)), F.struct(confidence, -F.col(order)))).alias(a)
        for a in attributes
    ]
    return candidates.groupBy(key).agg(*picks)


def identity_outcomes(batch: DataFrame, existing_keys: DataFrame) -> DataFrame:
    """Per candidate: MISSING_NAME, AMBIGUOUS_MERGE, existing or new.

    A name with several dedup keys, in the batch and the table together, is
    ambiguous, and then all its candidates are flagged.  ``batch`` and
    ``existing_keys`` have name_key and dedup_key; existing ones count by name.
    """
    keys = batch.select("name_key", "dedup_key").unionByName(existing_keys.select("name_key", "dedup_key"))
    spread = keys.groupBy("name_key").agg(F.count_distinct("dedup_key").alias("_keys"))
    there = existing_keys.select("dedup_key").distinct().withColumn("_there", F.lit(True))
    joined = batch.join(spread, "name_key").join(there, "dedup_key", "left")
    outcome = (
        F.when(F.col("name_key") == "|", "MISSING_NAME")
        .when(F.col("_keys") > 1, "AMBIGUOUS_MERGE")
        .when(F.col("_there"), "existing")
        .otherwise("new")
    )
    return joined.withColumn("outcome", outcome).drop("_keys", "_there")


def fill_gaps(existing: DataFrame, incoming: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Existing rows whose null attributes take the incoming values."""
    new = incoming.select(key, *[F.col(a).alias(f"_new_{a}") for a in attributes])
    joined = existing.join(new, key, "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) if c in attributes else F.col(c) for c in existing.columns]
    )


def insert_if_absent(batch: DataFrame, key: str, order: list[str], existing: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Batch rows with a disposition: the first of a key that the table lacks is
    inserted, all others are duplicates; a row without a key is ``no_key``.

    The batch is written once with a number for each row, so that the rows compared with
    their key's first are the very ones it was taken from; of rows equal in ``order`` the
    lowest number is the first.  Firsts are a minimum by key, so a hot key is summed
    before it is shuffled, and meet the rows by number, where no key is hot.
    ``existing`` has the stored keys, or is a function that gives those of the written
    rows' keys that are stored: what a table can look up need not be listed.
    """
    rows = numbered(batch, "_uid", "insert-batch")
    firsts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*order, "_uid")).alias("_first"))
    stored = existing(rows) if callable(existing) else existing
    there = stored.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    new = firsts.join(there, "_k", "left_anti").select(F.col("_first._uid").alias("_new"))
    joined = rows.join(new, F.col("_uid") == F.col("_new"), "left")
    disposition = F.when(F.col(key).isNull(), "no_key").when(F.col("_new").isNotNull(), "inserted").otherwise("duplicate")
    return joined.withColumn("disposition", disposition).drop("_uid", "_new")


#: Attributes of a person that a later record may fill.
PLAYER_ATTRIBUTES = ("grade", "school_name", "guardian_name", "photo_consent")


def load_players(candidates: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(players, candidates with a disposition) after the candidates' identities are resolved.

    A name with several identities is ambiguous and loads nothing.  Records of one
    identity are merged attribute by attribute, the most confident first; a stored player
    only has gaps filled.  A new player's id is a hash of the identity, so a second run
    finds it.  ``stored`` has id, first_name, last_name and may lack other columns.
    Candidates are told by a number of their own, as record ids may be missing or repeated.
    """
    candidates = numbered(candidates, "_uid", "load-candidates")
    own = lambda n: text.blank_to_null(field(F.col("payload"), n)).alias(n)
    names = ["first_name", "last_name", "birth_date", *PLAYER_ATTRIBUTES]
    keys = lambda df: df.withColumn("name_key", text.name_key(F.col("first_name"), F.col("last_name"))).withColumn(
        "dedup_key", text.dedup_key(F.col("first_name"), F.col("last_name"), F.col("birth_date"))
    )
    batch = keys(candidates.select("_uid", "record_id", "confidence_score", *[own(n) for n in names]))
    batch = batch.withColumn("_order", F.coalesce(F.crc32("record_id"), F.lit(1 << 32)))
    there = keys(stored.select("id", *[(F.col(n).cast("string") if n in stored.columns else F.lit(None).cast("string")).alias(n) for n in names]))
    judged = identity_outcomes(batch, there)
    good = judged.where(F.col("outcome").isin("new", "existing"))
    merged = merge_attributes(good, "dedup_key", names, "confidence_score", "_order")
    filled = fill_gaps(there, merged, "dedup_key", list(PLAYER_ATTRIBUTES)).select("id", *names)
    new = merged.join(there.select("dedup_key"), "dedup_key", "left_anti").select(F.xxhash64("dedup_key").alias("id"), *names)
    at = F.struct(F.col("record_id").isNull(), "record_id", "_uid")
    firsts = good.where("outcome = 'new'").groupBy("dedup_key").agg(F.min(at)["_uid"].alias("_first"))
    outcome = (
        F.when(F.col("outcome") == "existing", "merged")
        .when((F.col("outcome") == "new") & (F.col("_uid") == F.col("_first")), "inserted")
        .when(F.col("outcome") == "new", "duplicate")
        .otherwise(F.col("outcome"))
    )
    told = judged.join(firsts, "dedup_key", "left").select("_uid", outcome.alias("disposition"))
    return filled.unionByName(new), candidates.join(told, "_uid").drop("_uid")


def first_failure(payload_table: Column, outcomes: dict[str, Column]) -> Column:
    """The first reason that holds, in the order given; null if the record may load."""
    out = F.lit(None).cast("string")
    for reason, test in reversed(list(outcomes.items())):
        out = F.when(test, F.lit(reason)).otherwise(out)
    return out


def explode_model_output(items: DataFrame, content: str = "content") -> DataFrame:
    """One row per record of each item's JSON: wrapper, array or single object.

    Malformed text gives one row of confidence 0.  Payload fields may be nested under
    ``payload`` or inline.  Returns item columns, pos, target_table, confidence,
    payload (map), malformed.
    """
    clean = text.strip_fences(F.col(content))
    array_text = F.coalesce(
        F.get_json_object(clean, "$.records"),
        F.when(F.startswith(clean, F.lit("[")), clean),
        F.when(F.startswith(clean, F.lit("{")), F.concat(F.lit("["), clean, F.lit("]"))),
    )
    parsed = F.from_json(array_text, "array<map<string,string>>")
    usable = lambda p: F.coalesce(p.isNotNull() & F.forall(p, lambda m: m.isNotNull()), F.lit(False))
    # bound once: each use of the column would parse the text again
    either = text.let(parsed, lambda p: F.when(usable(p), p).otherwise(F.array(F.lit(None).cast("map<string,string>"))))
    rows = items.select(*items.columns, F.posexplode(either).alias("pos", "_m"))
    out = rows.withColumn("_ok", F.col("_m").isNotNull())
    envelope = ("target_table", "confidence", "confidence_score", "payload")
    nested = F.from_json(F.try_element_at("_m", F.lit("payload")), "map<string,string>")
    inline = F.map_filter("_m", lambda k, _: ~k.isin(*envelope))
    score = F.coalesce(F.try_element_at("_m", F.lit("confidence")), F.try_element_at("_m", F.lit("confidence_score")))
    return out.select(
        *items.columns,
        "pos",
        F.try_element_at("_m", F.lit("target_table")).alias("target_table"),
        F.when(F.col("_ok"), money.clamp_confidence(score)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("_ok"), F.coalesce(nested, inline)).otherwise(F.create_map(F.lit("raw"), F.col(content))).alias("payload"),
        (~F.col("_ok")).alias("malformed"),
    )


def lesson_blocks(lines: DataFrame) -> DataFrame:
    """Lines (source_file, pos, line) as lessons: title, topic, phenomenon, content.

    A LESSON marker opens a block that runs to the next; lines before the first are
    dropped if the file has one, else they are a block without a title.  The last
    marker of a kind wins; an empty TOPIC or PHENOMENON clears it, an empty TITLE is
    ignored.  Blocks follow a running count in a window per file.
    """
    mark = text.marker(F.col("line"))
    known = F.coalesce(mark["label"].isin("LESSON", "TITLE", "TOPIC", "PHENOMENON", "METRIC"), F.lit(False))
    marked = lines.select(
        "source_file", "pos", "line", F.when(known, mark["label"]).alias("label"), F.when(known, mark["rest"]).alias("rest")
    )
    running = Window.partitionBy("source_file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source_file")
    opens = F.coalesce(F.col("label") == "LESSON", F.lit(False)).cast("int")
    blocks = (
        marked.withColumn("block", F.sum(opens).over(running))
        .withColumn("_any", F.max(opens).over(whole))
        .where((F.col("block") > 0) | (F.col("_any") == 0))
    )
    latest = lambda name, test: F.max_by(F.when(test, F.col("rest")), F.when(test, F.col("pos"))).alias(name)
    is_ = lambda l: F.coalesce(F.col("label") == l, F.lit(False))  # noqa: E731, E741
    titled = (is_("LESSON") | is_("TITLE")) & (F.length("rest") > 0)
    body = F.array_sort(F.collect_list(F.when(F.col("label").isNull() & text.present(F.col("line")), F.struct("pos", "line"))))
    return blocks.groupBy("source_file", "block").agg(
        latest("title", titled),
        F.nullif(F.max_by(F.when(is_("TOPIC"), F.col("rest")), F.when(is_("TOPIC"), F.col("pos"))), F.lit("")).alias("topic"),
        F.nullif(F.max_by(F.when(is_("PHENOMENON"), F.col("rest")), F.when(is_("PHENOMENON"), F.col("pos"))), F.lit("")).alias("phenomenon"),
        F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("content"),
        F.count_if(is_("METRIC")).alias("n_metrics"),
    )


def metric_lines(lines: DataFrame) -> DataFrame:
    """``METRIC: name | type | value`` lines with an allowed type, numbered per file."""
    mark = text.marker(F.col("line"))
    parts = F.transform(F.split(mark["rest"], r"\|"), lambda x: F.trim(x))
    got = lines.where(mark["label"] == "METRIC").where(F.size(parts) >= 3).select(
        "source_file", "pos", F.get(parts, F.lit(0)).alias("player_name"),
        text.metric_type(F.get(parts, F.lit(1))).alias("metric_type"), F.get(parts, F.lit(2)).alias("value"),
    )
    order = Window.partitionBy("source_file").orderBy("pos")
    return got.where(F.col("metric_type").isNotNull()).withColumn("index", F.row_number().over(order) - 1)


#: Headers of the column that names a person.
PERSON_HEADERS = ("student", "player", "name", "learner", "pupil")


def table_metrics(tables: DataFrame) -> DataFrame:
    """Metric tables (source_file, header array, row_no, cells array) as one row a value.

    The header's first cell must be one of ``PERSON_HEADERS``, and a row's first names the
    person; other columns count where their header is a metric type and their cell is
    filled.  Runs of white space count as one space.  Tables with a table_no give each
    value's place as ``cell``.
    """
    place = [F.concat_ws("-", *[F.col(c).cast("string") for c in ("table_no", "row_no", "col")]).alias("cell")] if "table_no" in tables.columns else []
    own = ["table_no"] if place else []
    titled = F.lower(F.trim(F.get("header", F.lit(0)))).isin(*PERSON_HEADERS)
    head = tables.where(titled).select("source_file", *own, "row_no", "cells", F.posexplode("header").alias("col", "title"))
    single = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    cell, person = single(F.get("cells", F.col("col"))), single(F.get("cells", F.lit(0)))
    kind = text.metric_type(F.col("title"))
    return head.where((F.col("col") > 0) & kind.isNotNull() & (F.length(cell) > 0) & (F.length(person) > 0)).select(
        "source_file", "row_no", person.alias("player_name"), kind.alias("metric_type"), cell.alias("value"), *place
    )


def constraint_violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(constraint, key) of every row that breaks a check; null counts as passing."""
    tests = F.array_compact(F.array(*[F.when(F.coalesce(~c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return rows.select(F.explode(tests).alias("constraint"), F.col(key).cast("string").alias("key"))
