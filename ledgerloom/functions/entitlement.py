"""Entitlement rules of a product: a map of strings, as its keys may be null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import period_start

RULES = "map<string,string>"


def as_int(text: Column) -> Column:
    """Whole numbers; floats are cut, booleans and other texts are null."""
    t = F.trim(text)
    return F.when(F.rlike(t, F.lit(r"^-*\d+(\.\d+)?$")), F.try_to_number(F.regexp_extract(t, r"^(-?\d+)", 1), F.lit("S999999999999")).cast("long"))


def rule(rules: Column, name: str) -> Column:
    return F.try_element_at(rules, F.lit(name))


def allowance_units(rules: Column) -> Column:
    """Minutes from weekly or plain hours, else units, else sessions, else unlimited (null)."""
    hours = F.coalesce(as_int(rule(rules, "hours_per_week")), as_int(rule(rules, "hours")))
    return F.coalesce(hours * 60, as_int(rule(rules, "units")), as_int(rule(rules, "sessions")))


def is_recurring(rules: Column) -> Column:
    """A reset is named, or the weekly allowance is a key, even with a null value."""
    has_key = F.coalesce(F.map_contains_key(rules, "hours_per_week"), F.lit(False))
    return F.coalesce(rule(rules, "reset").isNotNull(), F.lit(False)) | has_key


def derive_window(rules: Column, today: Column) -> Column:
    """Struct (remaining_units, valid_from, valid_to) of a new entitlement."""
    recurring = is_recurring(rules)
    start = F.when(recurring, period_start(rule(rules, "reset"), today)).otherwise(today)
    months, days = as_int(rule(rules, "min_term_months")), as_int(rule(rules, "valid_days"))
    fixed = F.coalesce(F.lower(rule(rules, "fixed_window")) == "true", F.lit(False))
    end = (
        F.when(months.isNotNull(), F.add_months(start, months.cast("int")))
        .when(days.isNotNull(), F.date_add(start, days.cast("int")))
        .when(recurring & fixed, F.date_add(start, 7))
    )
    return F.struct(allowance_units(rules).alias("remaining_units"), start.alias("valid_from"), end.alias("valid_to"))


def reset_if_due(rules: Column, units: Column, valid_from: Column, today: Column) -> Column:
    """Struct (changed, remaining_units, valid_from) after a look at the period.

    Unused units of the last period are lost.  Without a stored period the current
    one is adopted and the units stay.
    """
    start = period_start(rule(rules, "reset"), today)
    due = F.coalesce(is_recurring(rules) & (start > valid_from), F.lit(False))
    adopted = F.when(is_recurring(rules) & valid_from.isNull(), start).otherwise(valid_from)
    return F.struct(
        due.alias("changed"),
        F.when(due, allowance_units(rules)).otherwise(units).alias("remaining_units"),
        F.when(due, start).otherwise(adopted).alias("valid_from"),
    )
