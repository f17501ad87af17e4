"""Schemas and constraints of the fourteen business tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that every table has, and the ones that devices add (not in the audit).
_COMMON = "id string, created_at timestamp, updated_at timestamp, location_id string"
_DEVICE = "client_id string, device_id string, client_timestamp timestamp"

# Business columns by table.
_OWN = {
    "locations": "name string",
    "schools": "name string, contract_status string",
    "users": "name string, role string, email string, password_hash string, school_id string",
    "guardians": "first_name string, last_name string, phone string, relationship string",
    "players": "first_name string, last_name string, birth_date date, grade string, school_id string, guardian_id string, "
    "consent_status string, consent_date date, photo_consent boolean, active boolean, dedup_key string",
    "consents": "player_id string, consent_type string, granted boolean, granted_at timestamp, method string, captured_by_user_id string",
    "products": "name string, type string, price_cents int, rules string",
    "entitlements": "player_id string, product_id string, status string, remaining_units int, valid_from date, valid_to date",
    "sessions": "player_id string, session_type string, started_at timestamp, ended_at timestamp, duration_minutes int, "
    "reference string, school_id string, logged_by string, natural_key string",
    "attendance": "session_id string, player_id string, attendance_date date, present boolean, school_id string, natural_key string",
    "payments": "player_id string, product_id string, amount_cents int, method string, paid_at timestamp, natural_key string",
    "lessons": "title string, topic string, phenomenon string, content string, original_file_ref string, school_id string, natural_key string",
    "student_metrics": "player_id string, lesson_id string, metric_type string, value string, measured_at timestamp, natural_key string",
    "sync_log": "device_id string, user_id string, entity string, record_id string, action string, client_timestamp timestamp, "
    "server_timestamp timestamp, client_id string, legacy_client_id_missing boolean",
}
SCHEMAS = {t: f"{_COMMON}, {own}" + ("" if t == "sync_log" else f", {_DEVICE}") for t, own in _OWN.items()}

# What a column may hold.
ALLOWED = {
    ("schools", "contract_status"): ("partner", "proposed"),
    ("products", "type"): ("pay_per_use", "subscription", "once_off_pass"),
    ("entitlements", "status"): ("active", "expired", "cancelled"),
    ("sessions", "session_type"): ("lesson", "kit", "esports", "lounge"),
    ("student_metrics", "metric_type"): ("typing_wpm", "typing_accuracy", "homework_done", "quiz_score", "observation"),
    ("sync_log", "action"): ("insert", "update", "delete", "skip"),
    ("users", "role"): ("founder", "manager", "facilitator"),
}
UNIQUE = {
    "locations": "name", "schools": "name", "products": "name", "players": "dedup_key", "sessions": "natural_key",
    "attendance": "natural_key", "payments": "natural_key", "lessons": "natural_key", "student_metrics": "natural_key",
    "sync_log": "client_id",
}
FOREIGN = {
    "schools": {"location_id": "locations"}, "players": {"school_id": "schools", "guardian_id": "guardians"},
    "consents": {"player_id": "players"}, "entitlements": {"player_id": "players", "product_id": "products"},
    "sessions": {"player_id": "players", "school_id": "schools"}, "attendance": {"session_id": "sessions", "player_id": "players"},
    "payments": {"player_id": "players", "product_id": "products"}, "student_metrics": {"player_id": "players", "lesson_id": "lessons"},
}


def checks(table: str) -> dict[str, Column]:
    return {f"{table}.{c}": F.col(c).isin(*values) for (t, c), values in ALLOWED.items() if t == table}


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys held by several rows; nulls may repeat."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent_id: str = "id") -> DataFrame:
    """Rows whose reference names no parent; a null reference is fine."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent_id).alias(column)), column, "left_anti")


def missing_columns(found: DataFrame, table: str) -> list[str]:
    """Columns of the schema that a stored table lacks, for additive migrations."""
    names = {c.split()[0] for c in SCHEMAS[table].split(", ")}
    return sorted(names - set(found.columns))
