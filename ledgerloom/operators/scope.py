"""Row-level scope: who may see and write which rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("founder", "manager", "facilitator")
#: Entities that facilitators may sync, and session types that they may log.
FACILITATOR_ENTITIES = ("attendance", "session", "student_metrics")
FACILITATOR_SESSIONS = ("lesson", "kit", "esports")


class ScopeError(ValueError):
    """A role, or the ids that it needs, are missing."""


@dataclass(frozen=True)
class Scope:
    role: str
    location_id: int | str | None = None
    school_id: int | str | None = None

    def __post_init__(self) -> None:
        if self.role not in ROLES:
            raise ScopeError(f"unknown role {self.role!r}")
        if self.role != "founder" and self.location_id is None:
            raise ScopeError(f"a {self.role} needs a location")
        if self.role == "facilitator" and self.school_id is None:
            raise ScopeError("a facilitator needs a school")

    @property
    def unrestricted(self) -> bool:
        return self.role == "founder"

    def reads(self, location: Column, school: Column | None = None) -> Column:
        """Predicate for every scan; devices and the like have no school."""
        if self.unrestricted:
            return F.lit(True)
        seen = location == F.lit(self.location_id)
        if self.role == "facilitator" and school is not None:
            seen = seen & (school == F.lit(self.school_id))
        return seen

    def may_write(self, location: Column, school: Column | None = None) -> Column:
        """Ids are compared as text, and a missing one fails."""
        if self.unrestricted:
            return F.lit(True)
        ok = location.cast("string") == F.lit(str(self.location_id))
        if self.role == "facilitator":
            ok = ok & ((school if school is not None else F.lit(None)).cast("string") == F.lit(str(self.school_id)))
        return F.coalesce(ok, F.lit(False))

    def stamp(self, rows: DataFrame) -> DataFrame:
        """Rows with the scope's own location, and a facilitator's school."""
        if self.unrestricted:
            return rows
        out = rows.withColumn("location_id", F.lit(self.location_id))
        return out.withColumn("school_id", F.lit(self.school_id)) if self.role == "facilitator" else out


def sync_gate(scope: Scope, entity: Column, known: tuple[str, ...], session_type: Column) -> Column:
    """Reason to reject an action before it is looked at; null if it may go on."""
    if scope.role != "facilitator":
        return F.when(~entity.isin(*known), F.lit("unknown_entity"))
    return (
        F.when(~entity.isin(*FACILITATOR_ENTITIES), F.lit("forbidden_entity"))
        .when((entity == "session") & ~F.coalesce(session_type.isin(*FACILITATOR_SESSIONS), F.lit(False)), F.lit("forbidden_session_type"))
    )
