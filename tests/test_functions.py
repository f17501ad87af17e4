"""Golden values of the scalar functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, entitlement, money, sealing, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


KNOWN, NONE = (1000, 3000, 5000, 35000), ()


@pytest.mark.parametrize(
    ("raw", "known", "cents"),
    [("R30", KNOWN, 3000), ("R30.00", KNOWN, 3000), ("30", KNOWN, 3000), ("3000", KNOWN, 3000), ("50", KNOWN, 5000),
     ("30", NONE, 3000), ("R7", NONE, 700), ("", NONE, None), ("abc", NONE, None), (None, NONE, None), ("nan", KNOWN, None),
     ("inf", KNOWN, None), ("30d", KNOWN, None), ("R1,000", NONE, 100000)],
)
def test_amount_to_cents(spark, raw, known, cents):
    prices = F.array(*[F.lit(x) for x in known]).cast("array<bigint>")
    assert value(spark, money.to_cents(F.lit(raw).cast("string"), prices)) == cents


def test_rand_text(spark):
    assert value(spark, money.rand_text(F.lit(3000))) == "R30"
    assert value(spark, money.rand_text(F.lit(3050))) == "R30.50"
    assert value(spark, money.parse_rand(F.lit("12.345"))) == 1235
    assert value(spark, money.parse_rand(F.lit("-1"))) is None
    assert value(spark, money.clamp_confidence(F.lit("1.7"))) == 1.0
    assert value(spark, money.clamp_confidence(F.lit("NaN"))) == 0.5


def test_names_and_keys(spark):
    assert value(spark, text.slug(F.lit("  De  Villiers "))) == "de villiers"
    assert value(spark, text.slug(F.lit("De Villiers"))) == "de villiers"
    born = dates.birth_date_text(F.lit("2010-04-01"))
    assert value(spark, text.dedup_key(F.lit("John"), F.lit("Smith"), born)) == "john|smith|2010-04-01"
    assert value(spark, text.dedup_key(F.lit("John"), F.lit("Smith"), F.lit(None))) == "john|smith|"
    assert value(spark, text.archive_key(F.lit("/data/source/lessons/week1.docx"))) == "raw/lessons/week1.docx"
    assert value(spark, text.archive_key(F.lit("week1.docx"))) == "raw/week1.docx"
    import hashlib

    want = "lessons:" + hashlib.sha256(b"lessons|light|a.docx").hexdigest()
    assert value(spark, text.load_key("lessons", lambda f: F.lit(" Light "), F.lit("a.docx"))) == want


@pytest.mark.parametrize("key", ["id_number", "ID Number", "national_id", "address", "physical_address", "street"])
def test_prohibited_keys(spark, key):
    assert value(spark, text.is_prohibited(F.lit(key)))


@pytest.mark.parametrize("key", ["first_name", "player_name"])
def test_allowed_keys(spark, key):
    assert not value(spark, text.is_prohibited(F.lit(key)))


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2010-04-01", "2010-04-01"), ("2010-04-01T00:00:00Z", "2010-04-01"), ("20100401", "2010-04-01"), ("not-a-date", ""),
     ("2024-13-01", ""), ("2024-02-30", ""), ("2024", ""), ("2024-1-5", ""), ("2024-01-05 garbage", ""), ("2024/01/01", ""),
     ("2010-04-01T23:00:00-05:00", "2010-04-01"), (None, "")],
)
def test_birth_dates(spark, raw, want):
    assert value(spark, dates.birth_date_text(F.lit(raw).cast("string"))) == want


def test_ages(spark):
    age = lambda a, b: value(spark, dates.age_years(F.lit(a), F.lit(b)))
    assert age(date(2012, 2, 29), date(2015, 2, 28)) == 2
    assert age(date(2012, 2, 29), date(2015, 3, 1)) == 3


def rules(text_):
    return F.from_json(F.lit(text_), entitlement.RULES)


@pytest.mark.parametrize(
    ("given", "units"), [('{"hours_per_week":3}', 180), ('{"hours":1}', 60), ('{"units":5}', 5), ('{"sessions":10}', 10), ('{"members":4}', None), ("{}", None)]
)
def test_allowance(spark, given, units):
    assert value(spark, entitlement.allowance_units(rules(given))) == units


def test_periods(spark):
    start = lambda reset, day: value(spark, dates.period_start(F.lit(reset).cast("string"), F.lit(day)))
    assert start("sunday", date(2024, 1, 3)) == date(2023, 12, 31)
    assert start("sunday", date(2023, 12, 31)) == date(2023, 12, 31)
    assert start(None, date(2024, 1, 3)) == date(2024, 1, 1)
    w = value(spark, entitlement.derive_window(rules('{"hours_per_week":3,"reset":"sunday","fixed_window":true}'), F.lit(date(2024, 1, 3))))
    assert tuple(w) == (180, date(2023, 12, 31), date(2024, 1, 7))
    w = value(spark, entitlement.derive_window(rules('{"members":4,"hours_per_week":2,"min_term_months":3}'), F.lit(date(2024, 1, 3))))
    assert tuple(w) == (120, date(2024, 1, 1), date(2024, 4, 1))
    r = value(spark, entitlement.reset_if_due(rules('{"hours_per_week":3,"reset":"sunday"}'), F.lit(10), F.lit(date(2023, 12, 31)), F.lit(date(2024, 1, 8))))
    assert tuple(r) == (True, 180, date(2024, 1, 7))
    assert value(spark, entitlement.is_recurring(rules('{"hours_per_week":null}')))


def test_utc_and_local_days(spark):
    late = F.to_timestamp(F.lit("2024-01-07T22:30:00Z"))
    assert value(spark, dates.local_date(late)) == date(2024, 1, 8)


def test_sealed_fields(spark):
    salt = sealing.new_salt()
    key = sealing.derive_key("secret", salt)
    assert len(key) == sealing.KEY_BYTES and key == sealing.derive_key("secret", salt) != sealing.derive_key("secret", sealing.new_salt())
    df = spark.range(500).select("id", F.when(F.col("id") > 0, F.lit("Thandi M")).alias("na.me"))
    rows = sealing.seal_fields(df, ["na.me"], key).collect()
    assert [r["na.me"] for r in rows if r["id"] == 0] == [None]
    sealed = [r["na.me"] for r in rows if r["id"] > 0]
    assert len({s["iv"] for s in sealed}) == len({s["ciphertext"] for s in sealed}) == 499
    again = spark.createDataFrame(sealed[:5], "iv string, ciphertext string").select(F.struct("iv", "ciphertext").alias("e"))
    other = sealing.derive_key("other", salt)
    opened = again.select(sealing.unseal(F.col("e"), key).alias("x"), sealing.unseal(F.col("e"), other).alias("y")).collect()
    assert {(r["x"], r["y"]) for r in opened} == {("Thandi M", None)}
