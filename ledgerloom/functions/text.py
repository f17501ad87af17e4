"""Text scalars: normal forms, keys, paths and labels, all as Columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Identifying fields of a table's natural key, in order.
LOAD_KEY_FIELDS = {
    "sessions": ("player_name", "session_type", "started_at", "ended_at"),
    "payments": ("player_name", "product_name", "amount", "paid_at"),
    "lessons": ("title",),
    "student_metrics": ("player_name", "metric_type", "measured_at", "value"),
}
SYNC_KEY_FIELDS = {
    "session": ("player_id", "session_type", "started_at", "ended_at"),
    "attendance": ("player_id", "attendance_date", "session_id"),
    "payment": ("player_id", "product_id", "amount_cents", "paid_at"),
    "student_metrics": ("player_id", "metric_type", "measured_at"),
}
#: Keys that never leave a payload, in canonical form.
PROHIBITED_KEYS = (
    "id", "idno", "idnumber", "nationalid", "nationalidnumber", "said", "saidnumber", "identity",
    "identitynumber", "identitydocument", "passport", "passportno", "passportnumber", "address",
    "physicaladdress", "homeaddress", "residentialaddress", "postaladdress", "streetaddress", "street",
    "streetname", "addressline1", "addressline2", "suburb", "postalcode", "zipcode", "zip",
)
#: Media type by file suffix.
MEDIA_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "heic": "image/heic", "pdf": "application/pdf",
}


def squeeze(value: Column) -> Column:
    """Trim and collapse white space, Unicode white space too; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", " "))


def slug(value: Column) -> Column:
    """Lower-case ``squeeze``: the form in which names and keys are compared."""
    return F.lower(squeeze(value))


def canonical_key(key: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")


def is_prohibited(key: Column) -> Column:
    return canonical_key(key).isin(*PROHIBITED_KEYS)


def present(value: Column) -> Column:
    """Not null and not blank."""
    return F.length(squeeze(value)) > 0


def blank_to_null(value: Column) -> Column:
    """The value itself, or null if it is blank."""
    return F.when(present(value), value)


def name_key(first: Column, last: Column) -> Column:
    return F.concat_ws("|", slug(first), slug(last))


def dedup_key(first: Column, last: Column, birth_date: Column) -> Column:
    """first|last|birth date, each part '' where it is missing."""
    return F.concat_ws("|", slug(first), slug(last), F.coalesce(birth_date.cast("string"), F.lit("")))


def hashed_key(table: str, parts: Sequence[Column], provenance: Column) -> Column:
    """``table:sha256(table|parts|provenance)`` over normalised parts."""
    joined = F.concat_ws("|", F.lit(table), *[slug(p) for p in parts], slug(provenance))
    return F.concat(F.lit(f"{table}:"), F.sha2(joined, 256))


def load_key(table: str, field, source_file: Column) -> Column:
    """Natural key of an extracted record; ``field(name)`` gives a payload Column."""
    return hashed_key(table, [field(f) for f in LOAD_KEY_FIELDS[table]], source_file)


def sync_key(entity: str, table: str, field) -> Column:
    """Natural key of a synced action."""
    return hashed_key(table, [field(f) for f in SYNC_KEY_FIELDS[entity]], F.lit("sync"))


def record_id(source: Column, table: Column, index: Column) -> Column:
    joined = F.concat_ws("|", F.coalesce(source, F.lit("")), table, index.cast("string"))
    return F.substring(F.sha1(joined), 1, 16)


def archive_key(path: Column) -> Column:
    """raw/<parent>/<name>; a bare name lies under raw/.  Windows paths count too."""
    posix = F.when(F.contains(path, F.lit("/")), path).otherwise(F.translate(path, "\\", "/"))
    parts = F.filter(F.split(posix, "/"), lambda p: F.length(p) > 0)
    return F.concat_ws("/", F.lit("raw"), F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ending, kind in MEDIA_TYPES.items():
        out = F.when(suffix(path) == ending, F.lit(kind)).otherwise(out)
    return out


def strip_fences(text: Column) -> Column:
    """Model output without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z0-9]*\s*", ""), r"\s*```$", ""))


def split_name(name: Column) -> Column:
    """Struct (first, last): the first word, and the rest."""
    parts = F.split(squeeze(name), " ")
    return F.struct(
        F.get(parts, F.lit(0)).alias("first"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " ").alias("last")
    )


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))))


def label(value: Column) -> Column:
    """snake_case as Title Case words."""
    return F.initcap(F.translate(value, "_", " "))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values])


def scope_cache_key(*parts: Column) -> Column:
    """URI-encoded parts joined by ':'."""
    return F.concat_ws(":", *[F.url_encode(F.coalesce(p.cast("string"), F.lit(""))) for p in parts])


def day_of(iso: Column) -> Column:
    """UTC day of an ISO time text: its first ten characters."""
    return F.substring(iso, 1, 10)


def marker(line: Column) -> Column:
    """Struct (label, rest) of a ``LABEL: rest`` line; null where there is no label."""
    found = F.regexp_extract(line, r"^\s*([^\s:]+)\s*:(.*)$", 1)
    rest = F.trim(F.regexp_extract(line, r"^\s*([^\s:]+)\s*:(.*)$", 2))
    return F.when(F.length(found) > 0, F.struct(F.upper(found).alias("label"), rest.alias("rest")))


#: The metric types, and the words that name one, in order.
METRIC_TYPES = ("typing_wpm", "typing_accuracy", "homework_done", "quiz_score", "observation")
METRIC_WORDS = (
    ("wpm", "typing_wpm"), ("words per minute", "typing_wpm"), ("accuracy", "typing_accuracy"),
    ("homework", "homework_done"), ("quiz", "quiz_score"), ("observation", "observation"), ("notes", "observation"),
)
#: What a consent's granted field may say.
FALSE_WORDS = ("false", "f", "no", "n", "0", "revoked", "revoke", "denied", "deny")
TRUE_WORDS = ("true", "t", "yes", "y", "1", "granted", "grant")


def metric_type(value: Column) -> Column:
    """An allowed type by name or by the first word that names one; else null."""
    v = slug(value)
    plain = F.translate(v, "- ", "__")
    out = F.when(plain.isin(*METRIC_TYPES), plain)
    for word, kind in METRIC_WORDS:
        out = out.when(F.contains(v, F.lit(word)), F.lit(kind))
    return out


def as_bool(value: Column, default: bool = True) -> Column:
    """True and false words; anything else is the default."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin(*FALSE_WORDS), F.lit(False)).when(v.isin(*TRUE_WORDS), F.lit(True)).otherwise(F.lit(default))
